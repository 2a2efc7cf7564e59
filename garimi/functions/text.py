"""Column functions on strings: white space, composed form, offsets of lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as a regex class body, the same characters in Java and RE2.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: The same characters, as text.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A string of these alone (up to Latin letters, and Hangul syllables) is in NFC. Two ranges keep the test cheap.
SURE = r"\x{00}-\x{2FF}\x{AC00}-\x{D7A3}"


def strip_ws(c: Column) -> Column:
    """Without outer white space, of any kind."""
    return F.btrim(c, F.lit(WS_CHARS))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Composed form (NFC). Only strings that may not be composed leave the JVM; null stays null."""
    return F.coalesce(_nfc(F.when((F.octet_length(c) != F.length(c)) & c.rlike(f"[^{SURE}]"), c)), c)


def line_start(text: Column, pos: Column) -> Column:
    """0-based start of the line that holds ``pos``: just past the last newline before it."""
    before = F.substring(text, F.lit(1), pos)
    return F.when(F.instr(before, "\n") > 0, pos - F.instr(F.reverse(before), "\n") + 1).otherwise(F.lit(0)).cast("int")


def line_end(text: Column, pos: Column) -> Column:
    """0-based end of the line that holds ``pos``: the next newline, else the end of the text."""
    at = F.locate("\n", text, 1) if isinstance(pos, int) else F.call_function("locate", F.lit("\n"), text, pos + 1)
    return F.when(at > 0, at - 1).otherwise(F.length(text)).cast("int")
