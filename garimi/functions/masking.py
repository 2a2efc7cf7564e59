"""Masks. Each keeps the length of what a detector finds; null stays null, an empty value stays empty."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimi import dictionaries as D

try:
    import ahocorasick
except ModuleNotFoundError:  # values are looked for one by one then
    ahocorasick = None

_ALNUM = r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class Policy:
    """Whether account and card numbers, and resident numbers, are masked whole."""

    account_card_full: bool = False
    rrn_full: bool = False


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))


def mask_name(v: Column) -> Column:
    """First character, and the last of three and more."""
    n = F.length(v)
    long = F.concat(F.substring(v, 1, 1), stars(n - 2), F.substring(v, -1, 1))
    return F.when(n == 0, v).when(n <= 2, F.concat(F.substring(v, 1, 1), F.lit("*"))).otherwise(long)


_PHONE_PARTS = r"^(01[016789])(-?)(\p{Nd}{3,4})(-?)(\p{Nd}{4})$"


def mask_phone(v: Column) -> Column:
    """Prefix, separators and the last four digits stay; what is no phone number is starred whole."""
    g = lambda i: F.regexp_extract(v, _PHONE_PARTS, i)
    return F.when(v.rlike(_PHONE_PARTS), F.concat(g(1), g(2), stars(F.length(g(3))), g(4), g(5))).otherwise(stars(F.length(v)))


def mask_email(v: Column) -> Column:
    """Up to two characters of the local part, and the domain, stay; one character is starred."""
    local = F.substring_index(v, "@", 1)
    domain = F.when(F.contains(v, F.lit("@")), F.substring(v, F.length(local) + 2, F.length(v))).otherwise(F.lit(""))
    n = F.length(local)
    keep = F.when(n <= 1, 0).otherwise(F.least(F.lit(2), n - 1))
    return F.when(F.length(v) == 0, v).otherwise(F.concat(F.substring(local, F.lit(1), keep), stars(n - keep), F.lit("@"), domain))


def mask_address(v: Column) -> Column:
    """The part before the first space stays; the rest is starred but for its spaces."""
    at = F.instr(v, " ")
    rest = F.regexp_replace(F.substring(v, at + 1, F.length(v)), r"(?s)[^ ]", "*")
    return F.when(at == 0, stars(F.length(v))).otherwise(F.concat(F.substring(v, F.lit(1), at), rest))


def mask_full(v: Column) -> Column:
    """Letters and digits starred, separators kept."""
    return F.regexp_replace(v, _ALNUM, "*")


def mask_keep_last(v: Column, keep: int = 4) -> Column:
    """The last ``keep`` letters or digits stay."""
    return F.regexp_replace(v, rf"{_ALNUM}(?=(?:[^\p{{L}}\p{{N}}]*{_ALNUM}){{{keep}}})", "*")


def mask_keep_ends(v: Column, first: int = 4, last: int = 4) -> Column:
    """The first and last letters or digits stay; on a short value both parts meet."""
    head = F.regexp_extract(v, rf"^(?:[^\p{{L}}\p{{N}}]*{_ALNUM}){{0,{first}}}", 0)
    return F.concat(head, mask_keep_last(F.substring(v, F.length(head) + 1, F.length(v)), last))


_RRN_PARTS = r"^(\p{Nd}{6})(-?)(\p{Nd}{7})$"


def mask_rrn(v: Column, policy: Policy = Policy()) -> Column:
    """The six digits of the date of birth stay; another shape is starred like ``mask_full``."""
    if policy.rrn_full:
        return mask_full(v)
    g = lambda i: F.regexp_extract(v, _RRN_PARTS, i)
    return F.when(v.rlike(_RRN_PARTS), F.concat(g(1), g(2), stars(F.lit(7)))).otherwise(mask_full(v))


def mask_value(type_: Column, v: Column, policy: Policy = Policy()) -> Column:
    """The mask of the type; an unknown or null type is starred whole."""
    account, card = (mask_full(v), mask_full(v)) if policy.account_card_full else (mask_keep_last(v), mask_keep_ends(v))
    by = {D.NAME: mask_name(v), D.PHONE: mask_phone(v), D.EMAIL: mask_email(v), D.ADDRESS: mask_address(v), D.ACCOUNT: account, D.CARD: card, D.RRN: mask_rrn(v, policy), D.PASSPORT: mask_full(v)}
    out = F
    for t, mask in by.items():
        out = out.when(type_ == t, mask)
    return out.otherwise(stars(F.length(v)))


def overlaid(text: str, starts: list[int], lengths: list[int], masks: list[str]) -> str:
    """The text with each mask written over its place, in one pass. ``starts`` ascend; masks whose places overlap
    are written from the last start to the first, those of one start in their order."""
    parts, at, i = [], 0, 0
    while i < len(starts):
        low, end, j = starts[i], starts[i] + lengths[i], i + 1
        while j < len(starts) and starts[j] < end:
            end = max(end, starts[j] + lengths[j])
            j += 1
        held = masks[i]
        if j > i + 1:
            held = text[low:end]
            for k in sorted(range(i, j), key=lambda k: (-starts[k], k)):
                o = starts[k] - low
                held = held[:o] + masks[k] + held[o + lengths[k] :]
        parts += (text[at:low], held)
        at, i = end, j
    return "".join([*parts, text[at:]])


@F.arrow_udf(T.StringType())
def _overlaid(text: pa.Array, masks: pa.Array) -> pa.Array:
    """``masks``: start_pos, i, n, mask of each finding, in order."""
    start, _, n, mask = (c.to_pylist() for c in masks.flatten().flatten())
    out, at = [], 0
    for t, size in zip(text.to_pylist(), masks.value_lengths().to_pylist(), strict=True):
        size = size or 0
        out.append(None if t is None else overlaid(t, start[at : at + size], n[at : at + size], mask[at : at + size]))
        at += size
    return pa.array(out, pa.string())


def mask_text(text: Column, found: Column) -> Column:
    """The text with every finding's place overwritten by the mask of its value, from the last start to the
    first; findings of the same start in their order. Where spans overlap the earlier start is written last.

    Built-in functions can only write one mask at a time over the whole text; the splice is one pass in Arrow
    batches, which texts without findings don't join."""
    keyed = F.sort_array(F.transform(found, lambda f, i: F.struct(f["start_pos"].alias("start_pos"), i.alias("i"), F.length(f["value"]).alias("n"), mask_value(f["type"], f["value"]).alias("mask"))))
    some = F.size(found) > 0
    return F.when(some, _overlaid(F.when(some, text), keyed)).when(found.isNotNull(), text)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _standing(text: pa.Array, starts: pa.Array, values: pa.Array) -> pa.Array:
    columns = (c.to_pylist() for c in (text, starts, values))
    return pa.array([None if t is None else [t[a : a + len(v)] == v for a, v in zip(s, vs, strict=True)] for t, s, vs in zip(*columns, strict=True)], pa.list_(pa.bool_()))


def standing(text: Column, found: Column) -> Column:
    """For each finding whether its value stands at its place in the text."""
    some = F.when(F.size(found) > 0, text)
    flags = _standing(some, F.transform(found, lambda f: f["start_pos"]), F.transform(found, lambda f: f["value"]))
    return F.coalesce(flags, F.array().cast("array<boolean>"))


def held_values(text: str, values: list[str]) -> list[bool]:
    """For each value whether it stands anywhere in the text; many values are looked for in one pass."""
    if len(values) < 64 or ahocorasick is None:
        return [v in text for v in values]
    wanted = ahocorasick.Automaton()
    for v in values:
        wanted.add_word(v, v)
    wanted.make_automaton()
    seen = {v for _, v in wanted.iter(text)}
    return [v in seen for v in values]


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _within(text: pa.Array, values: pa.Array) -> pa.Array:
    return pa.array([None if t is None else held_values(t, vs) for t, vs in zip(text.to_pylist(), values.to_pylist(), strict=True)], pa.list_(pa.bool_()))


def within(text: Column, values: Column) -> Column:
    """For each value of an array whether it stands anywhere in the text. As UTF-8 text, its bytes do just then."""
    return F.coalesce(_within(F.when(F.size(values) > 0, text), values), F.array().cast("array<boolean>"))
