"""Layout templates: where labels and findings stand on the pages of a form.

Matching is an inverted index: anchors are exploded and joined on equality, shared ones counted; no
document is compared with a template it shares nothing with. Documents and templates with the same anchors
are one in the index, so a form in a million copies is one set; the best match joins on pairs of rare anchors
alone, which a match cannot do without.

What is exploded or read from a packed file is never broadcast, for it is far larger than its estimated size
(``hint("merge")``).

Sizes of pages come from a table ``pages`` (doc_id, page_index, width, height); what stands on a page that
it doesn't hold has no place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi import patterns as P
from garimi.functions.offsets import each, occurrences
from garimi.functions.text import WS, line_start
from garimi.operators.layout import spans_covering
from garimi.staging import staged

ANCHOR = ["page_index", "label", "xb", "yb"]
PART = 1000  # documents of one template that meet its items in one task, for a form may be a third of all
MANY = 40  # anchors of a set up to which it is looked up by pairs


def bucket(value: Column, size: Column) -> Column:
    """Grid cell of a coordinate, halves to even; a page without size is cell 0."""
    return F.when(size <= 0, F.lit(0)).otherwise(F.bround(value / size / D.GRID)).cast("int")


def label_before(text: Column, pos: Column) -> Column:
    """The last layout label before ``pos`` on its line; empty if there is none."""
    start = line_start(text, pos)
    found = F.regexp_extract_all(F.substring(text, start + 1, pos - start), F.lit(P.LAYOUT_LABEL), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def _cells(rows: DataFrame, pages: DataFrame, bbox: Column) -> DataFrame:
    """Rows with a page (doc_id, page_index) with the grid cell of the centre of their box, as xb and yb."""
    size = pages.groupBy("doc_id", "page_index").agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    cx, cy = (bbox["x0"] + bbox["x1"]) / 2, (bbox["y0"] + bbox["y1"]) / 2
    return rows.join(size, ["doc_id", "page_index"]).withColumn("xb", bucket(cx, F.col("_w"))).withColumn("yb", bucket(cy, F.col("_h"))).drop("_w", "_h")


def _first_span(points: DataFrame, spans: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """The first covering span of each point (``key`` holds doc_id), as page and grid cell of its centre."""
    x = spans_covering(points, spans.filter("bbox is not null"))
    first = x.groupBy(*key).agg(F.min_by(F.struct("s_page_index", "s_bbox"), F.struct("s_span_ord", "s_span_id")).alias("s"))
    return _cells(first.select(*key, F.col("s.s_page_index").alias("page_index"), F.col("s.s_bbox").alias("_b")), pages, F.col("_b")).select(*key, "page_index", "xb", "yb")


def anchors(documents: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (doc_id, page_index, label, xb, yb): the layout signature of each document."""
    labels = each(documents, occurrences(F.col("text"), P.LAYOUT_LABEL), "m", "doc_id")
    labels = labels.select("doc_id", F.regexp_extract("m.value", P.LAYOUT_LABEL, 1).alias("label"), "m.start_pos", "m.end_pos")
    cells = _first_span(labels, spans, pages, ["doc_id", "label", "start_pos"])
    return cells.select("doc_id", *ANCHOR).distinct()


def item_positions(findings: DataFrame, spans: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, finding_id, start_pos, type, page_index, xb, yb, label) of findings that a span covers."""
    cells = _first_span(findings, spans, pages, ["doc_id", "finding_id", "type", "start_pos"])
    x = cells.join(documents.select("doc_id", "text"), "doc_id")
    return x.select("doc_id", "finding_id", "start_pos", "type", "page_index", "xb", "yb", label_before(F.col("text"), F.col("start_pos")).alias("label"))


def _sets(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The different anchor sets of the rows (``key`` and anchor): ``name``, the least key of each, with its anchors;
    and which set each key has."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*ANCHOR))).alias("anchors"))
    one = sets.groupBy("anchors").agg(F.min(key).alias(name))
    return one, sets.join(one.hint("merge"), "anchors").select(key, name)


def _scored(pairs: DataFrame, shared: str = "shared") -> DataFrame:
    return pairs.withColumn("score", F.col(shared) / (F.col("na") + F.col("nt") - F.col(shared)))


def similarities(a: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template_id, shared, score): Jaccard similarity of anchor sets with at least two in common."""
    docs, doc_of = _sets(a, "doc_id", "d")
    forms, form_of = _sets(templates.select("template_id", *ANCHOR), "template_id", "t")
    left = docs.select("d", F.size("anchors").alias("na"), F.explode("anchors").alias("a"))
    right = forms.select("t", F.size("anchors").alias("nt"), F.explode("anchors").alias("a"))
    shared = left.join(right, "a").groupBy("d", "t", "na", "nt").agg(F.count("*").alias("shared")).filter(F.col("shared") >= D.MIN_SHARED)
    return _scored(shared).join(doc_of, "d").join(form_of, "t").select("doc_id", "template_id", "shared", "score")


def _coded(sets: DataFrame) -> DataFrame:
    """Anchor sets (doc, k, anchors) as (doc, k, ids): numbers for the anchors, the rarest first."""
    rows = sets.select("doc", "k", F.explode("anchors").alias("a"))
    numbered = rows.groupBy("a").agg(F.count("*").alias("f")).withColumn("id", F.monotonically_increasing_id())
    own = rows.hint("merge").join(staged(numbered, "anchor-ids"), "a").groupBy("doc", "k").agg(F.array_sort(F.collect_list(F.struct("f", "id"))).alias("r"))
    return own.select("doc", "k", F.transform("r", lambda x: x["id"]).alias("ids"))


def _keys(ids: Column) -> Column:
    """What two sets that match at ``MATCH_AT`` have in common: a pair of the rarest anchors of each, all but so
    many that with one of these the others could not be enough. Sets of many anchors have many pairs: they, and
    those small enough to match them, meet by single anchors as well, the others then being too few alone."""
    n = F.size(ids)
    rare = lambda more: F.slice(ids, F.lit(1), n - F.ceil(n * D.MATCH_AT - 1e-9).cast("int") + more)
    pairs = F.flatten(F.transform(rare(2), lambda x, i: F.transform(F.slice(rare(2), i + 2, n), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    single = F.transform(rare(1), lambda x: F.struct(x.alias("x"), F.lit(-1).cast("long").alias("y")))
    none = F.slice(single, F.lit(1), F.lit(0))
    return F.concat(F.when(n <= MANY, pairs).otherwise(none), F.when(n >= MANY * D.MATCH_AT, single).otherwise(none))


def best_match(a: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template_id, score): the most similar template of each document, at least ``MATCH_AT`` with two
    anchors in common; the earliest of equals."""
    docs, doc_of = _sets(a, "doc_id", "d")
    forms, _ = _sets(templates.select("template_id", *ANCHOR), "template_id", "t")
    both = docs.select(F.lit(True).alias("doc"), F.col("d").alias("k"), "anchors").unionByName(forms.select(F.lit(False).alias("doc"), F.col("t").alias("k"), "anchors"))
    coded = staged(_coded(both), "anchor-sets")
    docs, forms = coded.filter("doc").select(F.col("k").alias("d"), F.col("ids").alias("da")), coded.filter("not doc").select(F.col("k").alias("t"), F.col("ids").alias("ta"))
    keyed = lambda x, k, ids, n: x.select(k, F.size(ids).alias(n), F.explode(_keys(F.col(ids))).alias("x")).select(k, n, "x.x", "x.y")
    pairs = keyed(docs, "d", "da", "na").join(keyed(forms, "t", "ta", "nt").hint("merge"), ["x", "y"])
    pairs = pairs.filter(F.least("na", "nt") >= F.greatest("na", "nt") * D.MATCH_AT - 1e-9).select("d", "t").distinct()
    x = pairs.join(docs.hint("merge"), "d").join(forms.hint("merge"), "t")
    x = x.select("d", "t", F.size("da").alias("na"), F.size("ta").alias("nt"), F.size(F.array_intersect("da", "ta")).alias("shared")).filter(F.col("shared") >= D.MIN_SHARED)
    good = _scored(x).filter(F.col("score") >= D.MATCH_AT)
    best = good.groupBy("d").agg(F.max(F.struct("score", (-F.col("t")).alias("back"))).alias("b"))
    return doc_of.join(best, "d").select("doc_id", (-F.col("b.back")).alias("template_id"), F.col("b.score").alias("score"))


def _around(c: str) -> Column:
    return F.explode(F.sequence(F.col(c) - D.NEAR, F.col(c) + D.NEAR))


def suggestions(matched: DataFrame, items: DataFrame, positions: DataFrame, spans: DataFrame, findings: DataFrame, pages: DataFrame) -> DataFrame:
    """What a matched template expects and no finding of the type covers: the value at that place, as 템플릿후보.

    ``items``: template_id, item_ord, type, page_index, xb, yb, label. Columns: doc_id, type, value, start_pos,
    end_pos. A place and what is near it meet by equality of cells, each item being known in the cells around its own."""
    parts = matched.groupBy("template_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("_p"))
    cut = items.hint("merge").join(parts, "template_id").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).drop("_p")
    mine = matched.join(parts, "template_id").select("doc_id", "template_id", F.pmod(F.xxhash64("doc_id"), F.col("_p")).cast("int").alias("_s"))
    want = mine.join(cut.hint("merge"), ["template_id", "_s"]).drop("_s")
    cell = ["doc_id", "page_index", "xb", "yb"]
    have = positions.select("doc_id", "type", "page_index", _around("xb").alias("xb"), "yb").select("doc_id", "type", "page_index", "xb", _around("yb").alias("yb")).distinct()
    open_ = want.join(have.hint("merge"), [*cell, "type"], "left_anti")
    places = spans.filter(F.col("bbox").isNotNull() & (F.regexp_replace("text", f"[{WS}]", "") != "")).select("doc_id", "page_index", "span_ord", "span_id", "text", F.col("start_pos").alias("at"), "bbox")
    places = _cells(places, pages, F.col("bbox")).drop("bbox")
    near = open_.withColumnRenamed("xb", "ix").withColumnRenamed("yb", "iy").withColumn("xb", _around("ix")).withColumn("yb", _around("iy")).hint("merge").join(places, cell)
    dx, dy = F.col("xb") - F.col("ix"), F.col("yb") - F.col("iy")
    w = Window.partitionBy("doc_id", "template_id", "item_ord").orderBy(dx * dx + dy * dy, "span_ord", "span_id")
    first = near.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    found = value_after_label(F.col("text"), F.col("label"))
    out = first.select("doc_id", "item_ord", "type", found["value"].alias("value"), (F.col("at") + found["start_pos"]).cast("int").alias("start_pos"))
    out = out.filter("value <> ''").withColumn("end_pos", (F.col("start_pos") + F.length("value")).cast("int"))
    out = out.join(findings.select("doc_id", "start_pos", "end_pos").distinct().hint("merge"), ["doc_id", "start_pos", "end_pos"], "left_anti")
    w = Window.partitionBy("doc_id", "start_pos", "end_pos").orderBy("item_ord")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("doc_id", "type", "value", "start_pos", "end_pos")


def value_after_label(text: Column, label: Column) -> Column:
    """(value, start_pos) within the span: what follows its label, else the whole span, without outer white space."""
    pattern = F.concat(F.lit(r"(?s)^(.*?\Q"), label, F.lit(rf"\E[{WS}]*[:：][{WS}]*)"))
    mark = F.call_function("regexp_extract", text, pattern, F.lit(1))
    rest = F.substring(text, F.length(mark) + 1, F.length(text))
    use = (label != "") & (F.length(mark) > 0) & (F.regexp_replace(rest, f"[{WS}]", "") != "")
    skip = F.when(use, F.length(mark)).otherwise(0)
    part = F.substring(text, skip + 1, F.length(text))
    start = skip + F.length(part) - F.length(F.regexp_replace(part, f"^[{WS}]+", ""))
    return F.struct(F.regexp_replace(part, f"^[{WS}]+|[{WS}]+$", "").alias("value"), start.alias("start_pos"))


TEMPLATE = "template_id long, kind string, item_ord int, page_index int, label string, xb int, yb int, type string, sample_count int"


def signatures(a: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, anchors, items (in document order): what one document teaches. An array holds a document's own
    labels or findings; documents that lack either teach nothing."""
    left = a.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(*ANCHOR))).alias("anchors"))
    item = F.struct("start_pos", "finding_id", "type", "page_index", "xb", "yb", "label")
    right = positions.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return left.join(right.hint("merge"), "doc_id")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the signatures in order; the store of templates is all that is held. A document meets the templates
    by an index of anchors: a match must share two of its rarest, all but so many that with one of these the others
    could not be enough."""
    kept: list[dict] = []
    once: dict = {}  # one copy of what the store holds many times
    holders: dict[tuple, list[int]] = defaultdict(list)
    for b in batches:
        for doc, anchors_, items in zip(b["doc_id"], b["anchors"], b["items"], strict=True):
            mine = {once.setdefault(x, x) for x in ((x["page_index"], x["label"], x["xb"], x["yb"]) for x in anchors_)}
            rare = sorted(mine, key=lambda x: len(holders[x]))[: len(mine) - math.ceil(len(mine) * D.MATCH_AT - 1e-9) + 2]
            met = Counter(chain.from_iterable(holders[x] for x in rare))
            best, score = -1, 0.0
            for k in sorted(k for k, n in met.items() if n > 1):
                n = len(mine & kept[k]["anchors"])
                s = n / (len(mine) + len(kept[k]["anchors"]) - n) if n >= D.MIN_SHARED else 0.0
                if s >= D.MATCH_AT and s > score:
                    best, score = k, s
            if best < 0:
                best = len(kept)
                kept.append({"id": int(doc), "anchors": set(), "items": {}, "n": 0})
            t = kept[best]
            for x in mine - t["anchors"]:
                holders[x].append(best)
            t["anchors"] |= mine
            for i in items:
                at = (i["type"], i["page_index"], i["xb"], i["yb"])
                t["items"].setdefault(once.setdefault(at, at), once.setdefault(i["label"], i["label"]))
            t["n"] += 1
    out = []
    for t in kept:
        out += [(t["id"], "anchor", None, p, label, x, y, None, t["n"]) for p, label, x, y in sorted(t["anchors"])]
        out += [(t["id"], "item", o, k[1], label, k[2], k[3], k[0], t["n"]) for o, (k, label) in enumerate(t["items"].items())]
        if len(out) > 50_000:
            yield _templates(out)
            out = []
    yield _templates(out)


def _templates(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["template_id", "kind", "item_ord", "page_index", "label", "xb", "yb", "type", "sample_count"])
    return out.astype({"item_ord": "Int32"})


def fold_templates(learned_from: DataFrame) -> DataFrame:
    """Templates learned from ``signatures`` in order of doc_id, one after the other: a document joins the best
    template that matches it, or becomes one (template_id is its doc_id). Columns of ``TEMPLATE``.

    A merge changes what later documents match, so learning is one ordered stream by nature: it is sorted on
    disk where it must be and walked in the memory of the store. Matching, which all documents need, is not."""
    return learned_from.repartition(1).sortWithinPartitions("doc_id").mapInPandas(_fold, TEMPLATE)


def anchors_of(learned: DataFrame) -> DataFrame:
    return learned.filter("kind = 'anchor'").select("template_id", *ANCHOR)


def items_of(learned: DataFrame) -> DataFrame:
    return learned.filter("kind = 'item'").select("template_id", "item_ord", "type", "page_index", "xb", "yb", "label")
