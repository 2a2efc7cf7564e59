"""Regex matches with their positions, inside the JVM, in time linear in the text and its matches.

A text is taken apart once into matches and the gaps between them. Positions are running sums of lengths;
lines, and the text just before or after a match, come from the gaps next to it, never from the text as a
whole, so that a document of any number of lines costs what its parts cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = "array<struct<value:string,start_pos:int,end_pos:int>>"
_CUT = "￿"  # no character: stands for a match while the text is cut
_CHUNK = 64  # elements that one fold appends to; folds of chunks are added up


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column, most: bool = False) -> Column:
    """Running sums (or maxima) of an array of ints. A fold copies what it appends to, so it appends to short
    chunks, and the chunks to one array."""
    both = F.greatest if most else lambda a, b: a + b
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1 if most else 0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.array_append(acc["out"], both(acc["at"], x)).alias("out"), both(acc["at"], x).alias("at"))

    def chunk(acc: Column, i: Column, all_: Column) -> Column:
        out = F.aggregate(F.slice(all_, i, F.lit(_CHUNK)), zero.withField("at", F.element_at(F.element_at(acc, -1), -1)), step, lambda a: a["out"])
        return F.array_append(acc, out)

    first = F.array(F.array(F.lit(-1 if most else 0)))
    starts = lambda all_: F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(_CHUNK))
    return let(xs, lambda all_: F.when(F.size(all_) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.slice(F.aggregate(starts(all_), first, lambda acc, i: chunk(acc, i, all_)), F.lit(2), F.size(all_)))))


def pieces(text: Column, pattern: str | Column, body: Callable[[Column, Column, Column], Column], none: Column, needs: str | None = None) -> Column:
    """``body(matches, gaps, ends)`` of a text with any match, else ``none``; null text gives null. There is a gap
    before each match and one after the last; ``ends`` are the matches' end positions.

    ``needs`` is a short literal without which no match is possible: a cheap test that spares most rows the regex."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole = F.when(F.contains(text, F.lit(_CUT)), F.translate(text, _CUT, "￾")).otherwise(text)
    gaps = F.split(F.regexp_replace(whole, p, F.lit(_CUT)), _CUT, -1)
    ends = lambda m, g: running(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda v, x: F.length(v) + F.length(x)))
    found = let(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(gaps, lambda g: let(ends(m, g), lambda e: body(m, g, e)))))
    if needs:
        found = F.when(F.contains(text, F.lit(needs)), found).otherwise(none)
    return F.when(text.isNotNull(), found)


def occurrences(text: Column, pattern: str | Column, needs: str | None = None) -> Column:
    """Every match as (value, start_pos, end_pos), 0-based half-open code points, in order, without overlap.
    Null text gives null; no match an empty array."""
    hit = lambda v, e: F.struct(v.alias("value"), (e - F.length(v)).cast("int").alias("start_pos"), e.cast("int").alias("end_pos"))
    return pieces(text, pattern, lambda m, _, ends: F.zip_with(m, ends, hit), F.array().cast(MATCHES), needs)


PLACED = "array<struct<value:string,start_pos:int,end_pos:int,line:int,before:string,after:string>>"


def _tail(s: Column) -> Column:
    """What follows the last newline."""
    return F.substring_index(s, "\n", -1)


def placed(text: Column, pattern: str, needs: str | None = None, before: int = 0, after: bool = False) -> Column:
    """``occurrences`` with line, the start of the line each begins on; before, the last ``before`` characters
    ahead of it on its line (matches of less than half of that aside); and after, what follows up to the end of
    the next match, or of the text."""

    def body(m: Column, g: Column, ends: Column) -> Column:
        def line(v: Column, i: Column) -> Column:
            start, last = F.get(ends, i) - F.length(v), F.get(m, i - 1)
            gap = F.get(g, i)
            earlier = F.when(F.contains(last, F.lit("\n")), F.get(ends, i - 1) - F.length(_tail(last))).otherwise(0)
            return F.coalesce(F.when(F.contains(gap, F.lit("\n")), start - F.length(_tail(gap))).otherwise(earlier), F.lit(0)).cast("int")

        def ahead(i: Column) -> Column:
            if not before:
                return F.lit("")
            near = lambda k: F.substring(F.get(g, k), -before, before)
            return F.substring(_tail(F.concat_ws("", near(i - 2), F.get(m, i - 2), near(i - 1), F.get(m, i - 1), near(i))), -before, before)

        def hit(v: Column, i: Column, lines: Column) -> Column:
            end = F.get(ends, i)
            rest = F.concat_ws("", F.get(g, i + 1), F.get(m, i + 1)) if after else F.lit("")
            return F.struct(v.alias("value"), (end - F.length(v)).cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), F.get(lines, i).alias("line"), ahead(i).alias("before"), rest.alias("after"))

        return let(running(F.transform(m, line), most=True), lambda lines: F.transform(m, lambda v, i: hit(v, i, lines)))

    return pieces(text, pattern, body, F.array().cast(PLACED), needs)


def among(xs: Column, keys: Column) -> Column:
    """For each element of an int array whether it is in another: both sorted together, not compared pairwise."""
    tagged = F.concat(F.transform(keys, lambda k: F.struct(k.cast("int").alias("k"), F.lit(-1).alias("i"))), F.transform(xs, lambda x, i: F.struct(x.cast("int").alias("k"), i.alias("i"))))

    def hits(sorted_: Column) -> Column:
        marks = running(F.transform(sorted_, lambda t: F.when(t["i"] < 0, t["k"]).otherwise(-1)), most=True)
        met = F.zip_with(sorted_, marks, lambda t, last: F.struct(t["i"].alias("i"), (last == t["k"]).alias("hit")))
        return F.transform(F.sort_array(F.filter(met, lambda t: t["i"] >= 0)), lambda t: t["hit"])

    return let(F.sort_array(tagged), hits)


def literal_occurrences(text: Column, value: Column) -> Column:
    """Every place of a literal string, without overlap; an empty or null string has none."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when((value != "") & F.contains(text, value), occurrences(text, quoted)).otherwise(F.array().cast(MATCHES))


def each(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """A row for each element of ``array``, as ``name``, with the columns ``keep``. The outer form keeps the
    optimizer from inferring a filter on the array's size, which would compute a costly array twice and,
    below an exchange, in too few tasks."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
