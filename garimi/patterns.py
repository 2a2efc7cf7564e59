"""Patterns of the detectors. Classes are spelled out, so that they mean the same in every regex engine:
any decimal digit, any Unicode white space, word boundaries by letters, numbers and underscore."""

from __future__ import annotations

from garimi import dictionaries as D
from garimi.functions.text import WS

ND = r"\p{Nd}"
_NOT_WORD_BEFORE, _NOT_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Fixed patterns of the regular types.
PHONE = rf"01[016789]-?{ND}{{3,4}}-?{ND}{{4}}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RRN = rf"{ND}{{6}}-{ND}{{7}}"
PASSPORT = rf"{_NOT_WORD_BEFORE}[A-Z]{ND}{{8}}{_NOT_WORD_AFTER}"
ACCOUNT = rf"{ND}{{2,6}}-{ND}{{1,6}}-{ND}{{2,8}}"
CARD = rf"{_NOT_WORD_BEFORE}{ND}{{4}}[- ]?{ND}{{4}}[- ]?{ND}{{4}}[- ]?{ND}{{4}}{_NOT_WORD_AFTER}"
HANGUL = "[가-힣]{2,4}"


def one_of(words: list[str]) -> str:
    """Alternation, longest first. Looking at the first character before trying the words is what makes it fast."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def label(words: list[str]) -> str:
    """A label with its colon and the white space around it, newlines included."""
    return f"{one_of(words)}[{WS}]*[:：][{WS}]*"


NAME_LABEL, BUSINESS_LABEL, ADDRESS_LABEL, REPEATED_LABEL = label(D.NAME_LABELS), label(D.BUSINESS_LABELS), label(D.ADDRESS_LABELS), label([D.REPEATED_NAME_LABEL])
PHONE_LABEL = f"{one_of(D.PHONE_CONTEXT_LABELS)}[{WS}]*[:：]"
#: White space within a line.
WS_LINE = WS.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")
TITLE_NAME = f"{one_of(D.BUSINESS_TITLES)}[{WS_LINE}]+{HANGUL}"
REGION = one_of(D.REGIONS)
LAYOUT_WORDS = sorted({*D.NAME_LABELS, *D.BUSINESS_LABELS, *D.ADDRESS_LABELS, *D.LAYOUT_LABELS}, key=lambda w: (-len(w), w))
LAYOUT_LABEL = f"({'|'.join(LAYOUT_WORDS)})[{WS}]*[:：]"
