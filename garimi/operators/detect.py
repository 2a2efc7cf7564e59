"""Detection of personal data in a text, as one expression over the row.

Each detector is an array of findings; concatenated in rule order, deduplicated by exact span,
cross-validated and sorted, all within the row: a scan and a projection, no shuffle, whatever the
number of documents. ``explode`` it where rows are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi import patterns as P
from garimi.functions.offsets import among, let, occurrences, pieces, placed, running
from garimi.functions.text import WS, line_end

MOST_WORDS = 20_000  # entries of a dictionary that may become part of a plan


@dataclass(frozen=True)
class Words:
    """The dictionaries of a detection: surnames, and words that are never a name."""

    surnames: Sequence[str] = tuple(D.SURNAMES)
    exclude: Sequence[str] = tuple(D.EXCLUDE_WORDS)


WORDS = Words()
FINDING = "struct<type:string,value:string,start_pos:int,end_pos:int,grp:string,approved:boolean,confidence:string,confidence_ord:int,cross_validated:boolean,source:string>"


def _level(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, D.CONFIDENCE)), n + 1)


def finding(type_: str, value: Column, start: Column, grp: str = D.GROUP_BASIC, confidence: int = 1, crossed: bool = False, source: str = D.SOURCE_AUTO) -> Column:
    level = F.lit(confidence)
    return F.struct(
        F.lit(type_).alias("type"), value.alias("value"), start.cast("int").alias("start_pos"), (start + F.length(value)).cast("int").alias("end_pos"), F.lit(grp).alias("grp"), F.lit(True).alias("approved"),
        F.lit(D.CONFIDENCE[confidence]).alias("confidence"), level.alias("confidence_ord"), F.lit(crossed).alias("cross_validated"), F.lit(source).alias("source"),
    )


def _all(hits: Column, type_: str, **kw) -> Column:
    return F.transform(hits, lambda m: finding(type_, m["value"], m["start_pos"], **kw))


# Within a detection each finding carries the start of its line and, of a phone number, whether a label stands
# before it there.
def _on_line(hits: Column, type_: str, labelled: bool = False, **kw) -> Column:
    return F.transform(hits, lambda m: F.struct(finding(type_, m["value"], m["start_pos"], **kw).alias("f"), m["line"].alias("line"), (m["labelled"] if labelled else F.lit(False)).alias("labelled")))


def _anywhere(found: Column) -> Column:
    """Findings of types whose line plays no part."""
    return F.transform(found, lambda f: F.struct(f.alias("f"), F.lit(-1).alias("line"), F.lit(False).alias("labelled")))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda e: e["f"])


def rrn_valid(v: Column) -> Column:
    """Whether ``dddddd-ddddddd`` ends in its check digit. Full-width digits count as digits; others don't."""
    digits = F.translate(v, "０１２３４５６７８９-", "0123456789")
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(D.RRN_WEIGHTS)), F.lit(0))
    return F.coalesce(digits.rlike("^[0-9]{13}$") & ((11 - total % 11) % 10 == F.substring(digits, 13, 1).try_cast("int")), F.lit(False))


def _near(text: Column, pattern: str, needs: str, words: list[str]) -> Column:
    """The matches with one of the words in the 15 characters before them on their line."""
    return F.filter(placed(text, pattern, needs, before=15), lambda m: m["before"].rlike("|".join(words)))


def phones(text: Column) -> Column:
    return _plain(_phones(text))


def emails(text: Column) -> Column:
    return _all(occurrences(text, P.EMAIL, "@"), D.EMAIL, confidence=2)


def rrns(text: Column) -> Column:
    return _all(F.filter(occurrences(text, P.RRN, "-"), lambda m: rrn_valid(m["value"])), D.RRN, confidence=2)


def passports(text: Column) -> Column:
    return _all(occurrences(text, P.PASSPORT), D.PASSPORT, confidence=2)


def accounts(text: Column) -> Column:
    return _all(_near(text, P.ACCOUNT, "-", D.ACCOUNT_CONTEXT), D.ACCOUNT, confidence=2)


def cards(text: Column) -> Column:
    return _all(_near(text, P.CARD, "카드", D.CARD_CONTEXT), D.CARD)


def after_labels(text: Column, pattern: str) -> Column:
    """The two to four syllables right after each label, as (value, start_pos, line); labels without are left out."""

    def word(m: Column) -> Column:
        line = F.when(F.contains(m["value"], F.lit("\n")), m["end_pos"] - F.length(F.substring_index(m["value"], "\n", -1))).otherwise(m["line"])
        return F.struct(F.regexp_extract(m["after"], f"^{P.HANGUL}", 0).alias("value"), m["end_pos"].alias("start_pos"), line.cast("int").alias("line"))

    return F.filter(F.transform(placed(text, pattern, after=True), word), lambda w: w["value"] != "")


def surname_word(word: Column, words: Words = WORDS) -> Column:
    """Not an excluded word, and starts with a surname: equality tests by length, not a join on a prefix."""
    starts = F.lit(False)
    for n in sorted({len(s) for s in words.surnames}):
        starts = starts | F.substring(word, 1, n).isin([s for s in words.surnames if len(s) == n])
    return ~word.isin(list(words.exclude)) & starts


def _names(text: Column, words: Words | None) -> Column:
    """After name labels, after approval labels, after titles."""
    is_name = lambda w: surname_word(w["value"], words) if words else F.lit(True)
    basic = _on_line(F.filter(after_labels(text, P.NAME_LABEL), is_name), D.NAME)
    approval = _on_line(F.filter(after_labels(text, P.BUSINESS_LABEL), is_name), D.NAME, grp=D.GROUP_BUSINESS, confidence=0)
    last = lambda m: F.regexp_extract(m["value"], f"{P.HANGUL}$", 0)
    titled = F.transform(placed(text, P.TITLE_NAME), lambda m: F.struct(last(m).alias("value"), (m["end_pos"] - F.length(last(m))).alias("start_pos"), m["line"].alias("line")))
    titled = _on_line(F.filter(titled, is_name), D.NAME, grp=D.GROUP_BUSINESS, confidence=0)
    return F.concat(basic, approval, titled)


def names(text: Column, words: Words | None = WORDS) -> Column:
    """Names by all rules; the first rule to claim a span keeps it. Without ``words``, whatever stands where a name
    would: which of it is a name is up to the value alone."""
    return dedupe(_plain(_names(text, words)))


def addresses(text: Column) -> Column:
    """The rest of the line after an address label, if it starts with a region and says more than that."""

    def rest(g: Column, i: Column, end: Column) -> Column:
        """Up to the newline in the gap that follows; only where another label stands on the line, by the text."""
        gap = F.get(g, i + 1)
        cut = F.contains(gap, F.lit("\n")) | (i + 2 == F.size(g))
        return F.when(cut, F.substring_index(gap, "\n", 1)).otherwise(F.substring(text, end + 1, line_end(text, end) - end))

    def value(raw: Column, end: Column) -> Column:
        v = F.regexp_replace(raw, f"^[{WS}]+|[{WS}]+$", "")
        return F.struct(v.alias("value"), (end + F.length(raw) - F.length(F.regexp_replace(raw, f"^[{WS}]+", ""))).cast("int").alias("start_pos"), F.length(F.regexp_extract(v, f"^{P.REGION}", 0)).alias("region"))

    found = pieces(text, P.ADDRESS_LABEL, lambda m, g, ends: F.transform(m, lambda _, i: value(rest(g, i, F.get(ends, i)), F.get(ends, i))), F.array().cast("array<struct<value:string,start_pos:int,region:int>>"))
    return _all(F.filter(found, lambda a: (a["region"] > 0) & (F.length(a["value"]) > a["region"])), D.ADDRESS, confidence=0)


def _phones(text: Column) -> Column:
    """Phone numbers with their line, and whether a phone label stands before them on it."""

    def body(m: Column, g: Column, ends: Column) -> Column:
        start = lambda v, i: F.get(ends, i) - F.length(v)
        tail = lambda i: F.substring_index(F.get(g, i), "\n", -1)
        lines = F.transform(m, lambda v, i: F.when(F.contains(F.get(g, i), F.lit("\n")), start(v, i) - F.length(tail(i))).otherwise(0).cast("int"))
        labels = F.transform(m, lambda v, i: F.when(tail(i).rlike(P.PHONE_LABEL), start(v, i)).otherwise(-1).cast("int"))
        hit = lambda v, i, ls, bs: F.struct(v.alias("value"), start(v, i).cast("int").alias("start_pos"), F.get(ls, i).alias("line"), (F.get(bs, i) >= F.get(ls, i)).alias("labelled"))
        return let(running(lines, most=True), lambda ls: let(running(labels, most=True), lambda bs: F.transform(m, lambda v, i: hit(v, i, ls, bs))))

    hits = pieces(text, P.PHONE, body, F.array().cast("array<struct<value:string,start_pos:int,line:int,labelled:boolean>>"), "01")
    return _on_line(hits, D.PHONE, labelled=True, confidence=2)


def dedupe(found: Column, of=lambda e: e, by_start: bool = False) -> Column:
    """The first finding of each exact span; overlapping different spans all stay. In their order, or by start,
    equal starts in their order. By sorting: copies of a span are neighbours then."""
    keyed = F.sort_array(F.transform(found, lambda e, i: F.struct(of(e)["start_pos"].alias("s"), of(e)["end_pos"].alias("t"), i.alias("i"), e.alias("e"))))
    new = lambda k, x, i: (i == 0) | (F.get(k, i - 1)["s"] != x["s"]) | (F.get(k, i - 1)["t"] != x["t"])
    rank = lambda x: F.struct((x["s"] if by_start else F.lit(0)).alias("s"), x["i"].alias("i"), x["e"].alias("e"))
    firsts = let(keyed, lambda k: F.filter(k, lambda x, i: new(k, x, i)))
    return F.transform(F.sort_array(F.transform(firsts, rank)), lambda x: x["e"])


def _bumped(f: Column) -> Column:
    level = F.least(f["confidence_ord"] + 1, F.lit(2))
    return f.withField("confidence_ord", level).withField("confidence", _level(level)).withField("cross_validated", F.lit(True))


def bump_phone_lines(found: Column) -> Column:
    """Names on a line whose phone number has a phone label before it go up one level, once a line."""
    lines = F.transform(F.filter(found, lambda e: e["labelled"]), lambda e: e["line"])

    def bump(ls: Column) -> Column:
        hot = among(F.transform(found, lambda e: e["line"]), ls)
        up = F.zip_with(found, hot, lambda e, h: F.when(h & (e["f"]["type"] == D.NAME), e.withField("f", _bumped(e["f"]))).otherwise(e))
        return F.when(F.size(ls) > 0, up).otherwise(found)

    return let(lines, bump)


def repeated_label_names(text: Column, found: Column) -> Column:
    """If one name label leads to a found name, the syllables after all such labels are candidates, whatever
    their surname; those found already are dropped with the other copies of a span."""
    starts = F.transform(F.filter(found, lambda e: e["f"]["type"] == D.NAME), lambda e: e["f"]["start_pos"])

    def added(words: Column) -> Column:
        new = _on_line(words, D.NAME, grp=D.GROUP_CROSS, confidence=0, crossed=True)
        return F.when(F.arrays_overlap(F.transform(words, lambda w: w["start_pos"]), starts), F.concat(found, new)).otherwise(found)

    return F.when(F.contains(text, F.lit(D.REPEATED_NAME_LABEL)), let(after_labels(text, P.REPEATED_LABEL), added)).otherwise(found)


NUMBERS = (emails, rrns, passports, accounts, cards)


def raw_findings(text: Column, words: Words = WORDS) -> Column:
    """All detectors in rule order."""
    return F.concat(phones(text), *[d(text) for d in NUMBERS], names(text, words), addresses(text))


def detect_all(text: Column | str, words: Words = WORDS) -> Column:
    """Findings of a text: detect, cross-validate, dedupe, sort by start. Null text gives null.

    The expression is large, and what it costs is building it: of a column given by its name it is built once.

    One dedupe at the end does for one before cross-validation as well: a name shares its span with other names
    alone, all of which move up together, and lead to the same candidates."""
    if isinstance(text, str):
        return _detect_named(text, words, id(SparkContext._gateway))
    raw = F.concat(_phones(text), *[_anywhere(d(text)) for d in NUMBERS], _names(text, words), _anywhere(addresses(text)))
    crossed = let(let(raw, bump_phone_lines), lambda fs: repeated_label_names(text, fs))
    return F.when(text.isNotNull(), _plain(dedupe(crossed, lambda e: e["f"], by_start=True)))


@lru_cache(32)
def _detect_named(text: str, words: Words, gateway: int) -> Column:
    return detect_all(F.col(text), words)


def hints(text: Column, found: Column) -> Column:
    """What looks like a number of a kind but fails its context or check digit, at no found span: for the
    reviewer only. Resident numbers, then account numbers, then card numbers."""
    kw = {"grp": D.GROUP_HINT, "confidence": 0, "source": D.SOURCE_HINT}
    numbers = F.concat(
        _all(F.filter(occurrences(text, P.RRN, "-"), lambda m: ~rrn_valid(m["value"])), D.RRN + "(추정)", **kw),
        _all(occurrences(text, P.ACCOUNT, "-"), D.ACCOUNT + "(추정)", **kw),
        _all(occurrences(text, P.CARD), D.CARD + "(추정)", **kw),
    )
    both = F.struct(numbers.alias("numbers"), found.alias("found"))
    return let(both, lambda b: F.when(F.size(b["numbers"]) == 0, b["numbers"]).otherwise(_not_at(b["numbers"], b["found"])))


def _not_at(items: Column, found: Column) -> Column:
    """The items at no span of ``found``, in order: both sorted together, spans of ``found`` first. No span has more
    than three items, one of each rule, so a span of ``found`` is at most three places ahead of its last one."""
    tag = lambda xs, own: F.transform(xs, lambda f, i: F.struct(f["start_pos"].alias("s"), f["end_pos"].alias("t"), (i if own else F.lit(-1)).alias("i")))

    def free(k: Column, x: Column, at: Column) -> Column:
        held = [F.coalesce((y["i"] < 0) & (y["s"] == x["s"]) & (y["t"] == x["t"]), F.lit(False)) for y in (F.get(k, at - n) for n in (1, 2, 3))]
        return (x["i"] >= 0) & ~(held[0] | held[1] | held[2])

    kept = let(F.sort_array(F.concat(tag(found, False), tag(items, True))), lambda k: F.filter(k, lambda x, at: free(k, x, at)))
    return F.transform(F.sort_array(F.transform(kept, lambda x: x["i"])), lambda i: F.get(items, i))


def classify(v: Column) -> Column:
    """The type a value looks like by its whole form; otherwise 기타. Null stays null."""
    whole = lambda p: v.rlike(rf"\A(?:{p})\z")
    return (
        F.when(v.isNull(), None).when(whole(P.PHONE), D.PHONE).when(whole(P.EMAIL), D.EMAIL).when(whole(P.RRN) & rrn_valid(v), D.RRN).when(whole(P.PASSPORT), D.PASSPORT)
        .when(whole(P.ACCOUNT), D.ACCOUNT).when(whole(P.CARD), D.CARD).when(whole(P.HANGUL) & surname_word(v), D.NAME).when(v.rlike(P.REGION), D.ADDRESS).otherwise(D.OTHER)
    )


def exploded(documents: DataFrame, found: Column, *keep: str) -> DataFrame:
    """A row for each finding, with emit_ord, its place in the array."""
    rows = documents.select("doc_id", *keep, F.posexplode_outer(found).alias("emit_ord", "f")).filter("f is not null")
    return rows.select("doc_id", *keep, "f.*", "emit_ord")


def findings(documents: DataFrame, words: Words = WORDS) -> DataFrame:
    """The findings of all documents (doc_id, text)."""
    return exploded(documents, detect_all("text", words))
