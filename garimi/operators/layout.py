"""Position operators: findings, spans of text on pages, points and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimi.functions.offsets import each, occurrences

BLOCK = 512  # characters: positions are joined block by block, so a long document isn't one key


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor(F.greatest(start, end - 1) / BLOCK)))


def spans_covering(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Interval join: every (finding, span) of a document that overlap, half-open. Equi-join on document and
    block; a pair that shares several blocks comes out in the first of them. Adds the span's columns, prefixed ``s_``."""
    f = findings.filter("start_pos < end_pos").withColumn("_b", _blocks(F.col("start_pos"), F.col("end_pos")))
    s = spans.filter("start_pos < end_pos").select("doc_id", *[F.col(c).alias(f"s_{c}") for c in spans.columns if c != "doc_id"])
    s = s.withColumn("_b", _blocks(F.col("s_start_pos"), F.col("s_end_pos")))
    both = f.join(s, ["doc_id", "_b"]).filter("s_start_pos < end_pos and s_end_pos > start_pos")
    return both.filter(F.col("_b") == F.floor(F.greatest("start_pos", "s_start_pos") / BLOCK)).drop("_b")


def page_of(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """finding_id, page: the page of the first span that holds the finding's start, else 0."""
    points = findings.select("finding_id", "doc_id", "start_pos", (F.col("start_pos") + 1).alias("end_pos"))
    held = spans_covering(points, spans).groupBy("finding_id").agg(F.min_by("s_page_index", F.struct("s_span_ord", "s_span_id")).alias("page"))
    return findings.select("finding_id").join(held, "finding_id", "left").select("finding_id", F.coalesce("page", F.lit(0)).alias("page"))


def rotation(dx: Column, dy: Column) -> Column:
    """Rotation of text that runs along (dx, dy)."""
    across = F.abs(dx) >= F.abs(dy)
    return F.when(across & (dx >= 0), 0).when(across, 180).when(dy > 0, 270).otherwise(90)


def text_width(text: Column, fontsize: Column) -> Column:
    """Font metric: an even 0.9 of the font size a character. Replace it by a table for another font."""
    return F.length(text) * fontsize * 0.9


def rect_plans(findings: DataFrame, spans: DataFrame, width=text_width) -> DataFrame:
    """For every covered span of a finding: the segment of the finding in it, where its text begins, and its
    box, projected along the direction of the text."""
    x = spans_covering(findings, spans)
    lo, hi = F.greatest("start_pos", "s_start_pos"), F.least("end_pos", "s_end_pos")
    cut = lambda a, b: F.substring(F.col("s_text"), (a + 1).cast("int"), (b - a).cast("int"))
    x = x.withColumn("prefix_w", width(cut(F.lit(0), lo - F.col("s_start_pos")), F.col("s_fontsize"))).withColumn("seg_w", width(cut(lo - F.col("s_start_pos"), hi - F.col("s_start_pos")), F.col("s_fontsize")))
    x = x.withColumn("rotate", rotation(F.col("s_dir.dx"), F.col("s_dir.dy"))).withColumn("bx", F.col("s_origin.x") + F.col("prefix_w") * F.col("s_dir.dx")).withColumn("by", F.col("s_origin.y") + F.col("prefix_w") * F.col("s_dir.dy"))
    x = x.withColumn("ex", F.col("bx") + F.col("seg_w") * F.col("s_dir.dx")).withColumn("ey", F.col("by") + F.col("seg_w") * F.col("s_dir.dy"))
    flat = F.col("rotate").isin(0, 180)
    return x.select(
        "finding_id", F.col("s_span_id").alias("span_id"), F.col("s_page_index").alias("page_index"), (lo - F.col("start_pos")).alias("seg_lo"), (hi - F.col("start_pos")).alias("seg_hi"), "rotate",
        F.col("bx").alias("baseline_x"), F.col("by").alias("baseline_y"),
        F.when(flat, F.least("bx", "ex")).otherwise(F.col("s_bbox.x0")).alias("x0"), F.when(flat, F.col("s_bbox.y0")).otherwise(F.least("by", "ey")).alias("y0"),
        F.when(flat, F.greatest("bx", "ex")).otherwise(F.col("s_bbox.x1")).alias("x1"), F.when(flat, F.col("s_bbox.y1")).otherwise(F.greatest("by", "ey")).alias("y1"),
    )


def rotated_pages(spans: DataFrame) -> DataFrame:
    """Pages with any text that doesn't run level."""
    return spans.groupBy("doc_id", "page_index").agg(F.bool_or(F.abs("dir.dy") > 0.01).alias("rotated")).filter("rotated").select("doc_id", "page_index")


def hidden_content_pages(pages: DataFrame) -> DataFrame:
    """Pages with an annotation or a form field; an attachment or optional content marks all pages of its document."""
    own = pages.filter("has_annot or has_widget").select("doc_id", "page_index")
    whole = pages.filter("embfile_count > 0 or has_ocg").select("doc_id").distinct()
    return own.unionByName(pages.select("doc_id", "page_index").join(whole, "doc_id", "left_semi")).distinct()


def approval_gate(pages: DataFrame, warned: DataFrame, views: DataFrame) -> DataFrame:
    """For every document: pages not seen yet, warned pages not opened on the canvas, and whether it may be
    approved. ``views``: doc_id, page_index, on_canvas."""
    seen = views.groupBy("doc_id", "page_index").agg(F.bool_or("on_canvas").alias("on_canvas"), F.lit(True).alias("seen"))
    p = pages.select("doc_id", "page_index").distinct().join(warned.distinct().withColumn("warned", F.lit(True)), ["doc_id", "page_index"], "left").join(seen, ["doc_id", "page_index"], "left")
    out = p.groupBy("doc_id").agg(F.count_if(F.col("seen").isNull()).alias("unseen_pages"), F.count_if(F.col("warned") & ~F.coalesce("on_canvas", F.lit(False))).alias("unopened_warnings"))
    return out.withColumn("may_approve", (F.col("unseen_pages") == 0) & (F.col("unopened_warnings") == 0))


CELL = 64.0  # points: positions on a page are joined cell by cell, so a full page isn't one key


def words_of(spans: DataFrame, width=text_width) -> DataFrame:
    """Words of all spans, whichever way they run, with their boxes and offsets: doc_id, page_index, span_id, word,
    start_pos, end_pos, x0, y0, x1, y1. Spans without a box have none; without a direction they run level."""
    way = F.coalesce("dir", F.struct(F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy")))
    placed = spans.filter("bbox is not null and origin is not null").withColumn("way", way)
    w = each(placed, occurrences(F.col("text"), r"[^ \t\n]+"), "w", "doc_id", "page_index", "span_id", "text", "fontsize", "origin", "bbox", "way", F.col("start_pos").alias("at"))
    before, own = width(F.substring(F.col("text"), F.lit(1), F.col("w.start_pos")), F.col("fontsize")), width(F.col("w.value"), F.col("fontsize"))
    begin = {c: F.col(f"origin.{c}") + before * F.col(f"way.d{c}") for c in "xy"}
    end = {c: begin[c] + own * F.col(f"way.d{c}") for c in "xy"}
    level = F.abs("way.dx") >= F.abs("way.dy")
    side = lambda c, along, pick: F.when(along, pick(begin[c], end[c])).otherwise(F.col(f"bbox.{c}{0 if pick is F.least else 1}"))
    return w.select(
        "doc_id", "page_index", "span_id", F.col("w.value").alias("word"), (F.col("at") + F.col("w.start_pos")).alias("start_pos"), (F.col("at") + F.col("w.end_pos")).alias("end_pos"),
        side("x", level, F.least).alias("x0"), side("y", ~level, F.least).alias("y0"), side("x", level, F.greatest).alias("x1"), side("y", ~level, F.greatest).alias("y1"),
    )


def _in_cells(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """A row for each cell of the page that the box touches, as cx and cy."""
    to = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.greatest(a, b) / CELL)))
    return df.withColumn("cx", to(x0, x1)).withColumn("cy", to(y0, y1))


_IN = ["doc_id", "page_index", "cx", "cy"]


def word_at(clicks: DataFrame, words: DataFrame) -> DataFrame:
    """The word under each click (click_id, doc_id, page_index, px, py); of several the nearest by its left
    edge, then the first. Clicks on empty space have none. A click meets the words of its cell alone."""
    at = clicks.withColumn("cx", F.floor(F.col("px") / CELL)).withColumn("cy", F.floor(F.col("py") / CELL))
    hit = at.join(_in_cells(words, "x0", "y0", "x1", "y1"), _IN).filter("px >= x0 and px <= x1 and py >= y0 and py <= y1")
    best = hit.groupBy("click_id").agg(F.min(F.struct(F.abs(F.col("x0") - F.col("px")).alias("far"), "start_pos", "span_id", "word", "end_pos")).alias("w"))
    return best.select("click_id", "w.word", "w.start_pos", "w.end_pos")


def region_of(drags: DataFrame, words: DataFrame) -> DataFrame:
    """From the first to the last word that lies at least half inside each box (drag_id, doc_id, page_index, rx0,
    ry0, rx1, ry1). They meet cell by cell; which cell does not matter, for first and last are the same."""
    x = _in_cells(drags, "rx0", "ry0", "rx1", "ry1").join(_in_cells(words, "x0", "y0", "x1", "y1"), _IN)
    w, h = F.least("x1", "rx1") - F.greatest("x0", "rx0"), F.least("y1", "ry1") - F.greatest("y0", "ry0")
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-6))
    inside = x.filter((w > 0) & (h > 0) & (w * h / area >= 0.5))
    return inside.groupBy("drag_id").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
