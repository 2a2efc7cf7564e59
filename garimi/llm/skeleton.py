"""One consistent form of text that looks the same.

The skeleton of a string: decompose it, drop what has no look, replace every character by the
prototype of its look-alikes, decompose again. Two strings look the same if their skeletons are equal.
Width makes no difference (full and half width, all space widths, dash widths); letter case, accents
and the presence of a space do. ASCII characters are their own prototypes, so 1, l and I or 0 and O
stay apart.

The canonical form is the skeleton composed again (NFC).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimi.llm.bloom import Bloom
from garimi.staging import staged

# Letters of other scripts that look like a Latin letter, by that letter.
LOOKALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ",
    "L": "Ꮮꓡ", "M": "МΜϺᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ",
    "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "ҮΥϒꓬⲨ", "Z": "ΖᏃꓜ", "a": "аαɑ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "еҽ", "g": "ցɡ", "h": "һհ", "i": "іι", "j": "јϳ",
    "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօσᴏⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕꜱ", "u": "υսᴜ", "v": "ѵνᴠ", "w": "ԝաᴡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "ı": "ı",
}
# Dashes of any width and other punctuation, by the ASCII character they look like.
PUNCTUATION = {"-": "‐‑‒–−﹣⁃", "'": "’‘ʼʹ′", '"': "“”″", ".": "․", ",": "‚", "/": "⁄∕", ":": "ː∶", "~": "∼˜", "·": "ㆍ‧∙⋅", "|": "∣ǀ"}


def _with_rules() -> Iterator[int]:
    """The code points beyond ASCII that a rule may name; ideographs, Hangul syllables, surrogates and private use have none."""
    for first, last in ((0x80, 0x33FF), (0xA000, 0xABFF), (0xF900, 0x1FFFF), (0xE0000, 0xE01EF)):
        yield from range(first, last + 1)


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """Look-alike table: the fixed letters and punctuation, and by rule every character whose Unicode
    decomposition says that it is another one in a different width or font, or as a
    radical, ligature or Roman numeral; spaces of any
    width become a space, characters without a look vanish."""
    table: dict[int, str] = {}
    for cp in _with_rules():
        ch = chr(cp)
        kind = unicodedata.category(ch)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        # Letters that another character sets as a radical, in one glyph or as a numeral.
        set_ = tag == "<compat>" and unicodedata.name(ch, "").startswith(("KANGXI RADICAL", "CJK RADICAL", "LATIN SMALL LIGATURE", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL"))
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D):
            table[cp] = ""
        elif tag in ("<wide>", "<narrow>", "<noBreak>", "<font>") or set_:
            table[cp] = "".join(chr(int(x, 16)) for x in rest.split())
    for target, letters in (*LOOKALIKES.items(), *PUNCTUATION.items()):
        for ch in letters:
            if ch != target:
                table[ord(ch)] = target
    for cp, to in list(table.items()):  # to the end of a chain: a non-breaking hyphen is a hyphen, a hyphen a minus sign
        for _ in range(3):
            to = "".join(table.get(ord(c), c) for c in to)
        table[cp] = to
    return table


_ASCII = re.compile(r"[\x00-\x7f]*")


def skeleton(s: str) -> str:
    """The skeleton of one string."""
    if _ASCII.fullmatch(s):
        return s
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", s).translate(prototypes()))


@F.pandas_udf(T.StringType())
def _skeleton(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else skeleton(x))


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", skeleton(x)))


def skeleton_col(c):
    """Skeleton of a column; ASCII strings don't leave the JVM."""
    return F.coalesce(_skeleton(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def canonical_col(c):
    """Canonical form of a column; equal for values that look the same, and for those alone, since composing
    loses nothing of a skeleton. Null stays null. Strings of ASCII and Hangul syllables are their own
    canonical form and don't leave the JVM."""
    return F.coalesce(_canonical(F.when(c.rlike(r"[^\x{00}-\x{7F}\x{AC00}-\x{D7A3}]"), c)), c)


def canonical(df: DataFrame, id_col: str, text_col: str, tbl: str) -> DataFrame:
    """tbl, id, doc_id, the stored string, its canonical form and whether they differ; repeated rows once."""
    out = df.select(F.lit(tbl).alias("tbl"), F.col(id_col).alias("id"), "doc_id", F.col(text_col).alias("stored")).distinct()
    out = out.withColumn("canonical", canonical_col(F.col("stored")))
    return out.withColumn("changed", ~F.col("stored").eqNullSafe(F.col("canonical")))


GROUP = ["doc_id", "look"]
HOT_SHARE = 1000  # a variant with more than one in so many rows is hot; there are fewer than that many
SALTS = 64  # parts a hot variant's rows are cut into


def _looks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc_id, v, look (the canonical form) of every row that can form a pair."""
    rows = df.select(F.col(id_col).alias("id"), "doc_id", F.col(text_col).alias("v")).filter("id is not null and doc_id is not null and v is not null")
    return rows.withColumn("look", canonical_col(F.col("v")))


def _mixed(df: DataFrame, id_col: str, text_col: str, tbl: str) -> DataFrame:
    """The rows, each once, of looks that a document may hold in different strings. What is shuffled to tell
    them are hashes; the rows of other looks are let go before they move."""
    rows = staged(_looks(df, id_col, text_col).withColumn("h", F.xxhash64(*GROUP)), f"looks-{tbl}")
    one, two = F.xxhash64("v"), F.xxhash64(F.lit(1), "v")  # 128 bits of a string, those of two strings being equal by no chance
    ends = rows.groupBy("h").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.min(two).alias("c"), F.max(two).alias("d"))
    mixed = staged(ends.filter("a <> b or c <> d").select("h"), f"mixed-{tbl}")
    return staged(rows.filter(Bloom(mixed, mixed.count()).might(F.col("h"))).drop("h").distinct(), f"held-{tbl}")


def _variants(rows: DataFrame) -> DataFrame:
    """doc_id, look, v, n: the different strings of each look in a document and how many rows hold each, of
    looks with at least two. Copies collapse on the map side, so a string with a third of all rows is few rows here."""
    each = rows.groupBy(*GROUP, "v").agg(F.count("*").alias("n"))
    mixed = each.groupBy(*GROUP).agg(F.count("*").alias("k")).filter("k > 1")
    return each.join(mixed, GROUP).select(*GROUP, "v", "n")


def _hot(kinds: DataFrame, rows: DataFrame) -> DataFrame:
    """Hashes of the hot variants, less than ``HOT_SHARE`` of them; a variant that shares one is only salted too."""
    least = max(1, rows.count() // HOT_SHARE)
    return kinds.filter(F.col("n") > least).select(F.xxhash64(*GROUP, "v").alias("_h"), F.lit(True).alias("hot")).distinct()


def _rows_of(rows: DataFrame, of: DataFrame, v: str, hot: DataFrame, id_name: str) -> DataFrame:
    """``of`` with a row for each row of its variant ``v``, whose id is added as ``id_name``. Rows of hot
    variants go by salt, what they meet to each salt."""
    named = lambda df: df.withColumn("_h", F.xxhash64(*GROUP, "v")).join(F.broadcast(hot), "_h", "left").drop("_h")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)
    left = named(rows).select(*GROUP, "v", F.col("id").alias(id_name), salt.cast("int").alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = named(of.withColumnRenamed(v, "v")).withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [*GROUP, "v", "salt"]).drop("v", "salt")


def same_look_pairs(df: DataFrame, id_col: str, text_col: str, tbl: str) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: rows of one document whose strings look the same but differ as stored.

    Pairs are formed of variants, the different strings of one look in a document, never of rows that hold
    the same string; each pair of variants then takes its rows, so that all work is in proportion to the
    rows read or given. Rows of a hot variant are spread by salt. Null strings and null documents form no
    pairs; rows that come twice count once."""
    rows = _mixed(df, id_col, text_col, tbl)
    kinds = staged(_variants(rows), f"variants-{tbl}")
    hot = _hot(kinds, rows)
    pairs = kinds.select(*GROUP, F.col("v").alias("va")).join(kinds.select(*GROUP, F.col("v").alias("vb")), GROUP).filter("va < vb")
    both = _rows_of(rows, _rows_of(rows, pairs, "va", hot, "ia"), "vb", hot, "ib")
    return both.select(F.lit(tbl).alias("tbl"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).filter("id_a < id_b").distinct()


def same_look_classes(df: DataFrame, id_col: str, text_col: str, tbl: str) -> DataFrame:
    """tbl, id, class_id, n_links: for every row the least id of its look in its document, and with how many
    rows it forms a pair: those of the look that hold another string. Rows without a document or a string
    are alone. Copies are counted, never expanded into pairs."""
    rows = staged(_looks(df, id_col, text_col).distinct(), f"looks-{tbl}")
    each = rows.groupBy(*GROUP, "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    look = each.groupBy(*GROUP).agg(F.sum("n").alias("rows"), F.min("least").alias("class_id"))
    of = each.join(look, GROUP).select(*GROUP, "v", "class_id", (F.col("rows") - F.col("n")).alias("n_links"))
    linked = _rows_of(rows, of, "v", _hot(each, rows), "id").select("id", "class_id", "n_links")
    alone = df.filter(F.col(id_col).isNotNull() & (F.col("doc_id").isNull() | F.col(text_col).isNull())).select(F.col(id_col).alias("id")).distinct()
    alone = alone.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).select(F.lit(tbl).alias("tbl"), "id", "class_id", "n_links")
