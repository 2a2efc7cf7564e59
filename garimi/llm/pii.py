"""Personal information inside free text.

Candidate spans come from wide patterns over the text in its look-alike form (offsets are kept). For
every candidate, labelers - patterns, gazetteers, context - vote for, against or not at all. The votes
of all candidates, counted by vote pattern (a bounded number), go to expectation-maximisation, which
estimates how far each labeler can be trusted without any labelled row. The resulting probabilities
train a final span classifier, a logistic regression on votes, shape and the words around the span,
fitted on a bounded sample (``TRAIN_SPANS``) and applied to every candidate. Of overlapping spans the
likelier one stays.

Two conditions are not left to chance: a resident number needs a right check digit, and a span needs
the shape of its type.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.llm.skeleton import canonical_col, prototypes
from garimi.staging import spread, staged

TRAIN_SPANS = 20_000  # spans the classifier is fitted on, at most about
GAZETTEER_DOCS = 2  # documents a given name must stand in to be known
FEATURE_BITS = 15
LEAST_SAY = 0.4  # log odds that any vote is presumed to be worth; labelers that err alike would else be taken for useless ones
PLACEHOLDER = "[{}]"
TYPES = (D.NAME, D.PHONE, D.EMAIL, D.RRN, D.PASSPORT, D.ADDRESS)


@lru_cache(1)
def _odd() -> frozenset[str]:
    """The characters that the look-alike table replaces."""
    return frozenset(map(chr, prototypes()))


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text composed, with look-alikes replaced and invisible characters dropped, and the offset of
    each of its characters in the original (None: they are the same)."""
    if text.isascii():
        return text, None
    table = prototypes()
    if unicodedata.is_normalized("NFC", text) and _odd().isdisjoint(text):
        return text, None
    out, at = [], []
    for m in re.finditer(r"[ᄀ-ᅟ][ᅠ-ᆧ][ᆨ-ᇿ]?|.[̀-ͯ]*", text, re.DOTALL):
        for c in unicodedata.normalize("NFC", m.group()):
            for d in table.get(ord(c), c):
                out.append(d)
                at.append(m.start())
    return "".join(out), at


@dataclass
class Span:
    """A candidate: folded offsets, votes by labeler, gazetteer keys."""

    type: str
    start: int
    end: int
    votes: list[int]
    keys: tuple[str, ...] = ()


_pattern = lru_cache(None)(lambda pattern: re.compile(pattern, re.IGNORECASE))


def _has(pattern: str, text: str, vote: int = 1) -> int:
    return vote if _pattern(pattern).search(text) else 0


def check_digit(digits: str) -> bool:
    """Whether the 13th digit is the one the first twelve give."""
    return (11 - sum(int(d) * w for d, w in zip(digits, D.RRN_WEIGHTS, strict=False)) % 11) % 10 == int(digits[12])


# --- numbers, mail, passports -------------------------------------------------------------------
_AREA = r"(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]|70|50\d?)"
_SEP = r"[ .\-]?"
PHONE = re.compile(
    rf"(?<![\d*])(?<!\d[-.])(?:\(\+82\){_SEP}0?|\+82{_SEP}(?:\(0\)|0)?)(?:1[016789]|{_AREA}){_SEP}\d{{3,4}}{_SEP}\d{{4}}(?![\d*])(?!-\d)"
    rf"|(?<![\d*])(?<!\d[-.])(?:\(0(?:1[016789]|{_AREA})\)|0(?:1[016789]|{_AREA})){_SEP}\d{{3,4}}{_SEP}\d{{4}}(?![\d*])(?!-\d)"
)
EMAIL = re.compile(r"(?<![\w.%+*-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?@ ?|\(at\)|\[at\])[A-Za-z0-9-]+(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]+)*(?:\.|\[dot\]|\(dot\))[A-Za-z]{2,}", re.ASCII)
RRN = re.compile(r"(?<![\d-])(\d{6})(?: ?- ?| )?(\d{7})(?![\d-])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z](?:\d{8}|\d{3}[A-Z]\d{4})(?![A-Za-z0-9])")
_NUMBER_CONTEXT = r"(계좌|카드|전표|버전|문서번호|관리번호|물품번호|사업자|invoice|lot|version|account|card)[^\n]{0,6}$"


def _phones(t: str) -> Iterator[Span]:
    for m in PHONE.finditer(t):
        left, right = t[max(0, m.start() - 14) : m.start()], t[m.end() : m.end() + 10]
        v = m.group()
        yield Span(D.PHONE, m.start(), m.end(), [
            1 if re.search(r"\d[ .\-)]", v) else 0,
            _has(r"(연락|전화|휴대|통화|☎|번호|문의|문자|call|contact|phone|tel|or|with)", left),
            _has(_NUMBER_CONTEXT, left, -1),
            1 if re.match(r"\(?(\+82|01)", v) else 0,
            _has(r"^(번|\)|에게| 확인|,| 또는|$| /)", right),
        ])


def _emails(t: str) -> Iterator[Span]:
    for m in EMAIL.finditer(t):
        left, v = t[max(0, m.start() - 14) : m.start()], m.group()
        yield Span(D.EMAIL, m.start(), m.end(), [
            1 if re.fullmatch(r"[^\s@]+@[^\s@\[(]+", v) else 0,
            _has(r"(\.|dot[\])])(com|net|org|kr|edu|gov|io|test|example|info|biz|co)$", v),
            _has(r"(메일|주소|mail|copy|✉|contact|통해|결과는|passport|<|,)", left),
            -1 if re.match(r"\d+ ?@", v) else 0,
            1 if re.search("[A-Za-z]", re.split("@|at", v)[0]) else -1,
        ])


def _residents(t: str) -> Iterator[Span]:
    for m in RRN.finditer(t):
        if not check_digit(m[1] + m[2]):
            continue
        left, right = t[max(0, m.start() - 14) : m.start()], t[m.end() : m.end() + 10]
        yield Span(D.RRN, m.start(), m.end(), [
            1 if 1 <= int(m[1][2:4]) <= 12 and 1 <= int(m[1][4:]) <= 31 else -1,
            1 if m[2][0] in "12345678" else -1,
            _has(r"(주민|외국인|신분|등록|ID no|자격)", left + right),
            _has(_NUMBER_CONTEXT, left, -1),
            1 if "-" in m.group() else 0,
        ])


def _passports(t: str) -> Iterator[Span]:
    for m in PASSPORT.finditer(t):
        left, right = t[max(0, m.start() - 14) : m.start()], t[m.end() : m.end() + 10]
        yield Span(D.PASSPORT, m.start(), m.end(), [
            1 if m.group()[0] in "MSRGDOTJ" else -1,
            _has(r"(여권|passport)", left),
            _has(r"(lot|invoice|version|버전|문서|관리|물품|계좌)[^\n]{0,4}$", left, -1),
            _has(r"(was shown|사본|,|$|\(재)", right),
            0,
        ])


# --- addresses ----------------------------------------------------------------------------------
_REGION = "|".join(sorted(D.REGIONS, key=len, reverse=True))
ADDRESS = re.compile(
    rf"(?<![가-힣A-Za-z0-9])(?:(?P<region>{_REGION}) +)?(?P<units>(?:[가-힣]{{1,7}}[시군구] +){{0,3}})"
    r"(?:(?P<road>[가-힣]{1,10}(?:대로|로|길)(?: ?\d{1,4}번?[가나다라]?길)?) ?|(?P<dong>[가-힣]{1,10}[동읍면리가](?: \d{1,3}통)?) )(?:지하 ?)?\d{1,5}(?:-\d{1,5})?(?![\d-])"
)
ADDRESS_LATIN = re.compile(
    r"(?<![A-Za-z0-9])\d{1,5}(?:-\d{1,5})?,? (?P<road>[A-Z][a-z]+(?:-[a-z]+)*-?(?:daero|ro|gil|dong|eup|myeon))(?: ?\d+(?:beon)?-gil)?(?P<units>(?:, [A-Z][a-z]+(?:-(?:si|gun|gu|do))?)*)"
)
_ADDRESS_DETAIL = re.compile(r"(?:, ?| )(?:[가-힣A-Z]+(?:아파트|빌딩|타워|상가|빌라|맨션)(?: ?\d+동)?|[A-Z가-힣]?\d*동)?(?: ?(?:지하 ?)?\d{1,4}(?:호|층))?")
_PLACE_CONTEXT = r"(주소|거주|수령지|우편물|반송지|사는|소재|자택|배송|lives at|address|to)"


def _addresses(t: str) -> Iterator[Span]:
    for pattern in (ADDRESS, ADDRESS_LATIN):
        for m in pattern.finditer(t):
            left, right = t[max(0, m.start() - 14) : m.start()], t[m.end() : m.end() + 26]
            latin = pattern is ADDRESS_LATIN
            detail = _ADDRESS_DETAIL.match(t, m.end())
            end = detail.end() if detail and not latin and detail.end() > m.end() + 1 and re.search(r"[동호층타워]", detail.group()) else m.end()
            units = m.group("units")
            yield Span(D.ADDRESS, m.start(), end, [
                1 if latin or m.group("region") else 0,
                1 if units.strip(" ,") else -1,
                _has(r"^ ?(m|km|%|㎡|℃|kg)|^ ?(원|개|명|건|점|부|상자|곳|일|년|월|회|차|시간|분)(?![가-힣]*(앞|거주))", right, -1),
                _has(_PLACE_CONTEXT, left + right),
                1 if latin or len((m.group("road") or (m.groupdict().get("dong") or ""))) >= 3 else -1,
            ])


# --- names --------------------------------------------------------------------------------------
_ONE = frozenset(s for s in D.SURNAMES if len(s) == 1)
_TWO = frozenset(s for s in D.SURNAMES if len(s) == 2)
_TITLES = "|".join(D.BUSINESS_TITLES)
# Further titles and forms of address that follow a name.
_ADDRESSED = "주무관|사무관|서기관|연구관|연구원|위원장|어르신|여사|교수|변호사|의원|기사"
_AFTER = re.compile(rf"(?:{_TITLES}|{_ADDRESSED})?(?:님|씨|군|양)?(?:은|는|이|가|을|를|의|과|와|도|께|께서|께서는|께는|에게|에게서|에게는|한테|라|라고|이라|이라고|이며|입니다|이고|로|으로|만|및)?")
_NO_NAMES = frozenset([*D.EXCLUDE_WORDS, *D.REGIONS, *[r + "의" for r in D.REGIONS]])
_HEAD = re.compile("[과팀실국부반계]장")
_RUN = re.compile(r"(?<![가-힣A-Za-z0-9])[가-힣]+")
_LEFT_ROLE = re.compile(
    r"(성명(\([^)]{1,4}\))?|이름|명의인?|신청인|수령인|예금주|담당자?|민원인|가입자|기안자?|검토자?|결재자?|협조자?|작성자|소지자|배우자|자녀|부모|보호자|대표자?|대리인|확인자|동행자|참석자?|발신[인자]|수신[인자]|신고인"
    rf"|사람은?|사본은|문의는|연락은|어제|오늘|까지|결과|이어서|사는|{_TITLES})\s*[:：]?\s*$|\($"
)
_RIGHT_ROLE = re.compile(
    rf"\s*(씨|님|선생|귀하|본인|올림|드림|명의|동행|동반|{_TITLES}|{_ADDRESSED})|\s?\(이하|[을를] 통해|\s?[(<]?(\+82|0\d{{1,2}}[-. )]|01\d)|,\s?(휴대폰|전화|여권|연락처|주민|메일|자녀|배우자)|\)\s?자격|,\s[가-힣]{{2,5}}[시군구도]?\s[^\n]*거주|<"
)
_DATE_AFTER = re.compile(r"[은는이가]\s\d{4}\s?[-./년]")
_ORG = re.compile(r"(팀|과|실|반|부서|은행|센터|조합|위원회|공사|공단|기관|회사|상사|식품|건설|전자|화학|기계|산업|물산|해운|테크|소프트|사업|계획|문서|번호|기간|금액|주소|관|장|단지|아파트)$")
LATIN = re.compile(r"(?<![\w@.\-])(?=([^\W\d_][^\W\d_']+) ([^\W\d_][^\W\d_'\-]+)(?![\w@\-]))")
# English words that begin sentences and headings of such documents.
_NOT_LATIN = frozenset(
    "please passport applicant invoice lot send spoke the travel records procurement facilities desk office team review note memo report unit we it all no mr ms mrs dr this that these passed storage room for and of to a an in on at by with id ID copy original".split()
)


def _hangul_names(t: str) -> Iterator[Span]:
    for m in _RUN.finditer(t):
        run, start = m.group(), m.start()
        left = t[max(0, start - 16) : start]
        cut: list[tuple[int, str, bool]] = []
        for surname in (run[:2] if run[:2] in _TWO else "", run[:1] if run[:1] in _ONE else ""):
            if not surname:
                continue
            for n in (2, 1):
                given = run[len(surname) : len(surname) + n]
                if len(given) == n and _AFTER.fullmatch(run, len(surname) + n):
                    cut.append((start + len(surname) + n, given, False))
        if run in _ONE or run in _TWO:  # surname and given name set apart
            s = re.match(r" ([가-힣]{2})([가-힣]*)", t[m.end() : m.end() + 10])
            if s and _AFTER.fullmatch(s[2]):
                cut.append((m.end() + 3, s[1], True))
        for end, given, apart in cut:
            right = t[end : end + 24]
            # A word of two syllables and a head's title is as soon a department's.
            org = end - start == 2 and not apart and bool(_HEAD.match(right)) or run in _NO_NAMES or bool(_ORG.search(run))
            listed = bool(re.search(r"(?:^|[:,])\s?[가-힣]{2,4},\s$|(?:참석|명단)\s?:\s$", left)) or bool(re.match(r",\s[가-힣]{2,4}(?:,|\s\(이상|\s동반)|\s\(이상", right))
            yield Span(D.NAME, start, end, [
                1 if _LEFT_ROLE.search(left) else 0,
                1 if _RIGHT_ROLE.match(right) else 0,
                1 if _DATE_AFTER.match(right) else 0,
                -1 if org else 0,
                1 if listed else -1 if apart else 0,
            ], ("H:" + given,))


def _latin_names(t: str) -> Iterator[Span]:
    for m in LATIN.finditer(t):
        a, b = m[1], m[2]
        if not (a[0].isupper() and b[0].isupper()) or re.search("[가-힣]", a + b):
            continue
        start, end = m.start(), m.start() + len(a) + 1 + len(b)
        left, right = t[max(0, start - 14) : start], t[end : end + 12]
        stop = a.lower() in _NOT_LATIN or b.lower() in _NOT_LATIN
        yield Span(D.NAME, start, end, [
            _has(r"(Mr\.|Ms\.|Mrs\.|Dr\.|contact|applicant|with|by|성명|이름|대문자|서명|확인|name)\s?:?\s?$", left),
            1 if re.match(r"( asked| lives|\s?\(|, ?passport|, ?여권| at |\.$|\.\s|님| 님| 씨|$|\n)", right) else 0,
            0,
            -1 if stop else 0,
            1 if a.istitle() and b.istitle() else 0,
        ], ("L:" + a.casefold(), "L:" + b.casefold()))


_MAKERS = (_phones, _emails, _residents, _passports, _addresses, _hangul_names, _latin_names)


@lru_cache(100_000)
def _shape(value: str) -> str:
    return re.sub(r"[가-힣]+", "가", re.sub(r"[A-Za-z]+", "A", re.sub(r"\d+", "9", value)))[:16]


@lru_cache(100_000)
def _index(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << FEATURE_BITS) - 1)


def _features(t: str, s: Span) -> list[int]:
    """Hashed features of a span besides its votes: the characters and words next to it, its shape."""
    left, right = t[max(0, s.start - 12) : s.start], t[s.end : s.end + 12]
    shape = _shape(t[s.start : s.end])
    words = (f"l1{left[-1:]}", f"l2{left[-2:]}", f"lw{(left.split() or [''])[-1][-4:]}", f"r1{right[:1]}", f"r2{right[:2]}", f"rw{(right.split() or [''])[0][:3]}", f"s{shape}", "b")
    script = "L" if s.type == D.NAME and s.keys and s.keys[0][0] == "L" else ""
    return [_index(f"{s.type}{script}|{w}") for w in words]


def spans(text: str) -> list[tuple]:
    """All candidates of a text, with offsets in it: (type, start, end, votes, keys, features)."""
    t, at = fold(text)
    out = []
    for make in _MAKERS:
        for s in make(t):
            a, b = (s.start, s.end) if at is None else (at[s.start], at[s.end] if s.end < len(t) else len(text))
            out.append((s.type, a, b, s.votes, list(s.keys), _features(t, s)))
    return out


VOTES, FEATURES = 6, 8  # of each candidate; the last vote is the gazetteer's
_SPANS = "array<struct<type:string,start:int,end:int,votes:array<int>,keys:array<string>,features:array<int>>>"
_ARROW = {"type": pa.string(), "start": pa.int32(), "end": pa.int32(), "votes": pa.list_(pa.int32()), "keys": pa.list_(pa.string()), "features": pa.list_(pa.int32())}


def _make_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            found = [spans(x) for x in part.column(2).to_pylist()]
            columns = list(zip(*[s for f in found for s in f], strict=True)) or [()] * len(_ARROW)
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.values(), strict=True)], list(_ARROW))
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(offsets, flat)], ["tbl", "row_id", "text", "spans"])


def free_texts(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """(tbl, row_id, text) of the rows in question, each once: all gold cases without their markers, and
    findings whose type is null or 기타. Null and empty texts and rows without an id hold nothing."""
    a = gold.select(F.lit("gold_cases").alias("tbl"), F.col("case_id").cast("long").alias("row_id"), F.regexp_replace("marked_text", r"\{\{(.*?)\}\}|\[\[(.*?)\]\]", "$1$2").alias("text"))
    b = findings.filter(F.col("type").isNull() | (F.col("type") == D.OTHER)).select(F.lit("findings").alias("tbl"), F.col("finding_id").cast("long").alias("row_id"), F.col("value").alias("text"))
    return a.unionByName(b).filter("row_id is not null and text <> ''").groupBy("tbl", "row_id").agg(F.min("text").alias("text"))


def gazetteer(findings: DataFrame) -> DataFrame:
    """Known parts of names (key): given names, and both words of names in Latin letters, that stand in at
    least ``GAZETTEER_DOCS`` documents as findings of type 이름, counted over all of them."""
    v = canonical_col(F.regexp_replace("value", r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\s]+(?=[가-힣])|[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""))
    names = findings.filter((F.col("type") == D.NAME) & F.col("value").isNotNull()).select("doc_id", v.alias("v")).distinct()
    one, two = "|".join(sorted(_ONE)), "|".join(sorted(_TWO))
    hangul = F.array(F.regexp_extract("v", f"^(?:{one})([가-힣]{{1,2}})$", 1), F.regexp_extract("v", f"^(?:{two})([가-힣]{{1,2}})$", 1))
    hangul = F.transform(F.filter(hangul, lambda x: x != ""), lambda x: F.concat(F.lit("H:"), x))
    latin = F.when(F.col("v").rlike(r"^\p{L}+ \p{L}+$") & ~F.col("v").rlike("[가-힣]"), F.transform(F.split(F.lower("v"), " "), lambda x: F.concat(F.lit("L:"), x))).otherwise(F.array().cast("array<string>"))
    keys = names.select("doc_id", F.explode(F.array_distinct(F.concat(hangul, latin))).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= GAZETTEER_DOCS).select("key")


# --- estimation ---------------------------------------------------------------------------------
def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a span is real, by vote pattern. EM over labelers that err independently: each
    vote multiplies the odds by the ratio of its rates among real and unreal spans. A vote is
    presumed to say a little of what it says (``LEAST_SAY``), never the opposite, and silence of a labeler that
    mostly votes for may only speak against, so the two classes cannot swap."""
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    p = 1 / (1 + np.exp(-(1.2 * votes.sum(axis=1) - 0.6)))
    for _ in range(rounds):
        real, unreal = (n * p).sum() + 2, (n * (1 - p)).sum() + 2
        logit = np.full(len(n), np.clip(np.log(real / unreal), -1.5, 1.5))
        for j in range(votes.shape[1]):
            favours = n[votes[:, j] > 0].sum() >= n[votes[:, j] < 0].sum()
            low_high = {1: (LEAST_SAY, 4.5), -1: (-4.5, -LEAST_SAY), 0: (-1.0, 0.0) if favours else (0.0, 0.0)}
            prior = {1: (2, 0.5), -1: (0.5, 2), 0: (2, 2)}
            for v, (low, high) in low_high.items():
                at = votes[:, j] == v
                a, b = ((n * p)[at].sum() + prior[v][0]) / real, ((n * (1 - p))[at].sum() + prior[v][1]) / unreal
                logit[at] += np.clip(np.log(a / b), low, high)
        p = 1 / (1 + np.exp(-logit))
    return {tuple(int(x) for x in v): float(q) for v, q in zip(votes, p, strict=True)}


def _vote_features(type_: str, votes: list[int]) -> list[int]:
    return [_index(f"{type_}|v{j}{v}") for j, v in enumerate(votes) if v]


def fit(rows: list[tuple[list[int], float]], rounds: int = 500) -> np.ndarray:
    """Weights of a logistic regression on sets of hashed features, by gradient descent with momentum."""
    w = np.zeros(1 << FEATURE_BITS)
    if not rows:
        return w
    index = np.concatenate([np.array(f, np.int64) for f, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    y = np.array([t for _, t in rows])
    seen = np.bincount(index, minlength=len(w)) + 1.0
    step = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, w[index], len(rows))))
        gradient = np.bincount(index, (y - p)[row], len(w)) / np.sqrt(seen) - 0.0005 * w
        step = 0.9 * step + 0.02 * gradient
        w += step
    return w


def _score(weights: np.ndarray):
    by_vote = np.zeros((len(TYPES), VOTES, 3))
    for k, type_ in enumerate(TYPES):
        for j in range(VOTES):
            for v in (-1, 1):
                by_vote[k, j, v + 1] = weights[_vote_features(type_, [0] * j + [v])[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tbl, row, text, found = (b.column(i) for i in range(4))
            kind, start, end, votes, _, features = found.flatten().flatten()
            k = pc.index_in(kind, value_set=pa.array(TYPES)).to_numpy(zero_copy_only=False)
            votes, features = votes.flatten().to_numpy().reshape(-1, VOTES), features.flatten().to_numpy().reshape(-1, FEATURES)
            score = weights[features].sum(axis=1) + by_vote[k[:, None], np.arange(VOTES), votes + 1].sum(axis=1)
            of = np.repeat(np.arange(b.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
            start, end = start.to_numpy(), end.to_numpy()
            good = np.flatnonzero(score > 0)
            good = good[np.lexsort((k[good], -end[good], start[good], -score[good], of[good]))]
            out: list[tuple] = []
            at, taken, value = -1, [], ""
            for i in good.tolist():
                if of[i] != at:
                    at, taken, value = of[i], [], text[of[i]].as_py()
                a, z = int(start[i]), int(end[i])
                if all(z <= x or a >= y for x, y in taken):
                    taken.append((a, z))
                    out.append((at, TYPES[k[i]], a, z, value[a:z], 1 / (1 + np.exp(-score[i]))))
            rows, *columns = list(zip(*out, strict=True)) or [()] * 6
            rows = pa.array(rows, pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([tbl.take(rows), row.take(rows), *arrays], ["tbl", "row_id", "pii_type", "start_pos", "end_pos", "value", "probability"])

    return run


HOT_MOST, HOT_SHARE = 256, 0.001  # keys that go by broadcast: so many at most, each at least that share of all


def known_keys(keys: DataFrame, names: DataFrame) -> DataFrame:
    """tbl, row_id, known: the keys of each row (tbl, row_id, key) that ``names`` holds. Frequent keys, which a
    mergeable sketch names, meet a broadcast of those alone; only the others are shuffled by key."""
    top, n = keys.agg(F.expr(f"approx_top_k(key, {HOT_MOST}, {HOT_MOST * 16})"), F.count("*")).first()
    hot = F.col("key").isin([t["item"] for t in top or [] if t["count"] >= max(2, HOT_SHARE * n)])
    met = keys.filter(~hot).join(names.filter(~hot), "key").unionByName(keys.filter(hot).join(F.broadcast(names.filter(hot)), "key"))
    return met.groupBy("tbl", "row_id").agg(F.collect_list("key").alias("known"))


class Detector:
    """The operator: candidates and their votes over all rows, estimation, and the fitted classifier."""

    def __init__(self, texts: DataFrame, names: DataFrame):
        made = staged(spread(texts.select("tbl", "row_id", "text")).mapInArrow(_make_spans, f"tbl string, row_id long, text string, spans {_SPANS}"), "spans")
        # Gazetteer votes come by a join on the distinct keys of each row; neither side is collected.
        keys = made.select("tbl", "row_id", F.explode(F.array_distinct(F.flatten("spans.keys"))).alias("key"))
        known = known_keys(keys, staged(names, "gazetteer"))
        held = made.join(known, ["tbl", "row_id"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        hits = lambda s: F.size(F.array_intersect(s["keys"], F.col("known")))
        vote = lambda s: F.when(F.size(s["keys"]) == 0, 0).when(hits(s) == F.size(F.array_distinct(s["keys"])), 1).when(hits(s) == 0, -1).otherwise(0)
        self.rows = staged(held.withColumn("spans", F.transform("spans", lambda s: s.withField("votes", F.concat(s["votes"], F.array(vote(s)))))).drop("known"), "votes")
        self.each = self.rows.select("tbl", "row_id", F.explode("spans").alias("s")).select("tbl", "row_id", "s.*")

    def reliabilities(self) -> dict[str, dict[tuple[int, ...], float]]:
        """Probability by type and vote pattern. At most 3**6 patterns a type reach the driver."""
        script = F.when(F.col("type") == D.NAME, F.coalesce(F.substring(F.get("keys", F.lit(0)), 1, 1), F.lit(""))).otherwise(F.lit(""))
        counts = self.each.groupBy("type", script.alias("script"), "votes").count().collect()
        kinds = {(r["type"], r["script"]) for r in counts}
        return {t + s: estimate([(tuple(r["votes"]), r["count"]) for r in counts if (r["type"], r["script"]) == (t, s)]) for t, s in kinds}

    def weights(self) -> np.ndarray:
        """The classifier, fitted on about ``TRAIN_SPANS`` spans chosen by hash."""
        belief = self.reliabilities()
        n = self.each.count()
        share = min(1.0, TRAIN_SPANS / max(1, n))
        picked = self.each.filter(F.pmod(F.xxhash64("tbl", "row_id", "start", "end"), F.lit(1_000_000)) < int(share * 1_000_000))
        rows = []
        script = F.when((F.col("type") == D.NAME) & (F.size("keys") > 0), F.substring(F.get("keys", F.lit(0)), 1, 1)).otherwise("")
        for type_, of, votes, features in zip(*picked.select("type", script, "votes", "features").toArrow().to_pydict().values(), strict=True):
            vote, y = _vote_features(type_, votes), belief[type_ + of][tuple(votes)]
            # Once more without the words around it: votes have to carry a span between words never seen.
            rows += [(features + vote, y), (features[-1:] + vote, y)]
        return fit(rows)

    def found(self) -> DataFrame:
        """tbl, row_id, pii_type, start_pos, end_pos, value, probability of every accepted span."""
        schema = "tbl string, row_id long, pii_type string, start_pos long, end_pos long, value string, probability double"
        return self.rows.select("tbl", "row_id", "text", "spans").mapInArrow(_score(self.weights()), schema)


def redact(found: DataFrame, texts: DataFrame) -> DataFrame:
    """tbl, row_id, redacted, n_spans: the texts with every span replaced by a placeholder of its type, the
    rest unchanged; texts without a span as they are."""
    marks = found.groupBy("tbl", "row_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("marks"))
    rows = texts.join(marks, ["tbl", "row_id"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<start_pos:bigint,end_pos:bigint,pii_type:string>>")))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    piece = lambda a, m: F.struct(F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (m["start_pos"] - a["at"]).cast("int")), F.format_string(PLACEHOLDER.replace("{}", "%s"), m["pii_type"])).alias("out"), m["end_pos"].alias("at"))
    end = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    return rows.select("tbl", "row_id", F.aggregate("marks", zero, piece, end).alias("redacted"), F.size("marks").alias("n_spans"))
