"""Audit log, names of outputs, summaries and history. Counts and types only, never a value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.operators.ranking import numbered

FLAG = "⚠ 있음"
IDS = 100_000  # ids a block spans when names or numbers are given out: at most so many rows a task, ids being unique


def format_counts(counts: Column) -> Column:
    """A map of type to count as ``type:count`` by type, joined by ``;``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")


def parse_counts(text: Column) -> Column:
    """The map back from its text; parts that are no ``type:count`` are left out."""
    parts = F.filter(F.split(text, ";"), lambda p: p.rlike("^[^:]+:[0-9]+$"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.substring_index(p, ":", -1).cast("long").alias("v"))))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def output_names(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Name of each result (doc_id, doc_type, day): ``type_day_NNN.pdf``, numbered on from the largest
    number of the day over all types. Numbers are given per day, in order of doc_id, block by block of ids."""
    used = existing.select(F.regexp_extract("output_filename", r"^.+_(\d{8})_(\d{3,})\.pdf$", 1).alias("day"), F.regexp_extract("output_filename", r"^.+_(\d{8})_(\d{3,})\.pdf$", 2).cast("int").alias("n")).filter("day <> ''")
    top = used.groupBy("day").agg(F.max("n").alias("top"))
    x = numbered(batch, ["day"], F.floor(F.col("doc_id") / IDS), ["doc_id"], "n").join(top, "day", "left").withColumn("serial", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("int"))
    # An unknown type is written as the catch-all type; characters that no file name may hold become _.
    kind = F.regexp_replace(F.coalesce("doc_type", F.lit("기타")), r'[\\/:*?"<>|]', "_")
    return x.select("doc_id", "day", "serial", F.format_string("%s_%s_%03d.pdf", kind, "day", "serial").alias("output_filename"))


_NAME = r"^(.+?)(\.[^.]*)?$"  # stem and suffix
_ROOT = r"^(.+?)((?:\([1-9][0-9]*\))*)(\.[^.]*)?$"  # stem without its numbers, the numbers, suffix


def _free_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk a partition sorted by root and id: each file takes its name or the first free number. What is held
    are the different names of one root and the next number of each, not the files."""
    root, taken, following = None, set(), {}
    for b in batches:
        out = []
        for of, i, name, stem, suffix in zip(b["root"], b["id"], b["name"], b["stem"], b["suffix"], strict=True):
            if of != root:
                root, taken, following = of, set(), {}
            dest = name
            if name in taken and not pd.isna(i):
                n = following.get(name, 1)
                while (dest := f"{stem}({n}){suffix}") in taken:
                    n += 1
                following[name] = n + 1
            taken.add(dest)
            if not pd.isna(i):
                out.append((int(i), name, dest))
        yield pd.DataFrame(out, columns=["id", "name", "dest"])


def unique_names(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A free name for each file (id, name), in order of id: its own, else with ``(1)``, ``(2)``, ... before the
    suffix, the first that neither ``existing`` (name) nor an earlier file of the batch holds.

    Names that share a root with a numbered or existing name, whose numbers may be taken, are given out one
    after the other, each root in its order; all others are numbered in blocks of ids. Files without an id or a
    name don't come out."""
    part = lambda i: F.regexp_extract("name", _ROOT, i)
    at = lambda i: F.regexp_extract("name", _NAME, i)
    of = lambda df: df.select(*df.columns, F.struct(part(1).alias("stem"), part(3).alias("suffix")).alias("root"), (part(2) != "").alias("numbered"))
    rows = of(files.select(F.col("id").cast("long").alias("id"), "name").filter("id is not null and name is not null"))
    marks = rows.filter("numbered").select("root")
    held = None
    if existing is not None:
        held = of(existing.select(F.lit(None).cast("long").alias("id"), "name").distinct())
        marks = marks.unionByName(held.select("root"))
    marks = marks.distinct()
    easy = numbered(rows.join(marks, "root", "left_anti").select("id", "name"), ["name"], F.floor(F.col("id") / IDS), ["id"], "nth")
    n = F.col("nth") - 1
    easy = easy.select("id", "name", F.when(n == 0, F.col("name")).otherwise(F.concat(at(1), F.lit("("), n.cast("string"), F.lit(")"), at(2))).alias("dest"))
    hard = rows.join(marks, "root", "left_semi")
    hard = hard if held is None else hard.unionByName(held)
    hard = hard.select(F.to_json("root").alias("root"), "id", "name", at(1).alias("stem"), at(2).alias("suffix"))
    hard = hard.repartition("root").sortWithinPartitions("root", F.col("id").asc_nulls_first()).mapInPandas(_free_names, "id long, name string, dest string")
    return easy.unionByName(hard)


def already_processed(path: Column, keywords: Column) -> Column:
    """Lies in the folder of results, or carries the marker."""
    return F.coalesce(F.element_at(F.split(path, "/"), -2) == D.FOLDERS["masked"], F.lit(False)) | F.coalesce(F.contains(keywords, F.lit(D.PROCESSED_MARKER)), F.lit(False))


def processor(saved: Column, user: Column) -> Column:
    """The saved name without outer spaces, else the user's."""
    return F.coalesce(F.nullif(F.trim(saved), F.lit("")), user)


def audit_rows(results: DataFrame) -> DataFrame:
    """Rows as they are appended to the log; seconds to one decimal, null without any."""
    return results.select("audit_id", "logged_at", "processor", "original_filename", "original_sha256", "output_filename", format_counts(F.col("counts")).alias("masked_counts"), F.bround("review_seconds", 1).alias("review_seconds"))


def summary(log: DataFrame) -> DataFrame:
    """The report text of each processed file."""
    lines = F.array_join(F.transform(F.filter(F.split("masked_counts", ";"), lambda p: p != ""), lambda p: F.concat(F.lit("  - "), F.substring_index(p, ":", 1), F.lit(": "), F.substring_index(p, ":", -1), F.lit("건"))), "\n")
    body = F.when(F.coalesce(F.length(lines), F.lit(0)) == 0, F.lit("  (없음)")).otherwise(lines)
    # Fixed report lines.
    rotated = F.when(F.col("rotated_text_warning"), F.lit("  - ⚠ 회전된 텍스트가 있습니다. 자동 탐지가 놓쳤을 수 있으니 육안으로 재확인하세요."))
    hidden = F.when(F.col("hidden_content_warning"), F.lit("  - ⚠ 주석/폼필드/첨부파일 등 숨겨진 콘텐츠가 있습니다. 별도 확인이 필요합니다."))
    warning = F.concat_ws("\n", rotated, hidden)
    block = F.when(warning == "", F.lit("")).otherwise(F.concat(F.lit("\n경고 사항:\n"), warning, F.lit("\n")))
    text = F.concat(
        F.lit("처리 결과 요약\n================\n원본 파일명 : "), F.coalesce("original_filename", F.lit("")), F.lit("\n처리일시    : "), F.coalesce("logged_at", F.lit("")), F.lit("\n처리자      : "), F.coalesce("processor", F.lit("")),
        F.lit("\n결과물 파일명: "), F.coalesce("output_filename", F.lit("")), F.lit("\n마스킹 유형별 건수:\n"), body, F.lit("\n"), block,
    )
    return log.select("audit_id", text.alias("report"))


def history(log: DataFrame) -> DataFrame:
    """The log for display: position 1 is the newest; flags as text."""
    flag = lambda c: F.when(F.col(c), F.lit(FLAG)).otherwise(F.lit(""))
    # Ranges of ids are sorted in parallel; the position follows from the count, ids being unique.
    return log.select("audit_id", "logged_at", "processor", "original_filename", "output_filename", "masked_counts", "review_seconds", flag("rotated_text_warning").alias("rotated_text"), flag("hidden_content_warning").alias("hidden_content")).orderBy(F.desc("audit_id"))


def originals(log: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept file (name) of each logged original: of that name, else the first by name that starts with its
    stem and ends with its suffix; else null.

    Both are equality joins. For the second, every kept name is known by the beginnings of its stem, of the
    lengths that the stems looked for have (a file name is short), reduced to the least name of each
    beginning before it moves."""
    stem, suffix = lambda c: F.regexp_extract(c, _NAME, 1), lambda c: F.regexp_extract(c, _NAME, 2)
    names = kept.select("name").distinct()
    a = log.select("audit_id", "original_filename")
    exact = a.join(names.select(F.col("name").alias("original_filename"), F.col("name").alias("same")), "original_filename", "left")
    open_ = exact.filter("same is null and original_filename is not null").select(stem("original_filename").alias("stem"), suffix("original_filename").alias("suffix")).distinct()
    lengths = [r[0] for r in open_.select(F.length("stem")).distinct().collect()]  # as many as a file name is long at most
    # A name ends with its own suffix and, as every name does, with none.
    ends = F.array_distinct(F.array(F.struct(stem("name").alias("of"), suffix("name").alias("suffix")), F.struct(F.col("name").alias("of"), F.lit("").alias("suffix"))))
    mine = names.select("name", F.explode(ends).alias("e")).select("name", "e.of", "e.suffix")
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("of")), lambda n: F.substring(F.col("of"), F.lit(1), n))
    first = mine.select("suffix", "name", F.explode(starts).alias("stem")).groupBy("stem", "suffix").agg(F.min("name").alias("first"))
    x = exact.withColumn("stem", stem("original_filename")).withColumn("suffix", suffix("original_filename")).join(first.join(open_, ["stem", "suffix"], "left_semi"), ["stem", "suffix"], "left")
    return x.select("audit_id", "original_filename", F.coalesce("same", "first").alias("kept_as"))


# Fixed result codes of a file.
REASONS = {0: "완료", 1: "탐지 없음", 2: "취소", 3: "자체 검증 실패", 4: "이미 처리됨", 5: "오류", 6: "작업 폴더 오류"}


def batch_summary(results: DataFrame) -> DataFrame:
    """Files by result code, with its reason."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return results.groupBy("code").agg(F.count("*").alias("files")).withColumn("reason", F.coalesce(F.element_at(reason, F.col("code")), F.lit("알 수 없음")))


def failure_reason(message: Column) -> Column:
    """Reason of a failed conversion: the first list with a keyword in the message, letter case aside."""
    low, out = F.lower(message), F
    for reason, words in D.FAILURE_REASONS.items():
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = out.when(test, reason)
    return out.otherwise(F.concat(F.lit(D.UNKNOWN_FAILURE), message))


def trust_report(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Extension: by day, week (its Monday) and month, and by document type within each, with totals: findings,
    the shares of them kept and unchecked, additions by hand a document. ``span`` is day, week, month or all."""
    at = F.col("received_at")
    d = documents.select("doc_id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(F.date_trunc("week", at), "yyyy-MM-dd").alias("week"), F.date_format(at, "yyyy-MM").alias("month"), "doc_type")
    manual = F.col("source") == D.SOURCE_MANUAL
    x = findings.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("approved").alias("kept"), F.count_if(~F.col("approved") & ~F.coalesce(manual, F.lit(False))).alias("unchecked"), F.count_if(manual).alias("manual")).join(d, "doc_id")
    times = ["day", "week", "month"]
    sets = [s for t in times for s in ([t, "doc_type"], [t])] + [[]]
    total = lambda c: F.sum(c).alias(c)
    g = x.groupingSets(sets, *times, "doc_type").agg(*[F.grouping(c).alias(f"_{c}") for c in [*times, "doc_type"]], F.count("*").alias("documents"), F.sum("n").alias("findings"), total("kept"), total("unchecked"), total("manual"))
    span = F.when(F.col("_day") == 0, "day").when(F.col("_week") == 0, "week").when(F.col("_month") == 0, "month").otherwise("all")
    share = lambda c: (F.col(c) / F.col("findings")).alias(f"{c}_share")
    return g.select(span.alias("span"), F.coalesce(*times).alias("start"), (F.col("_doc_type") == 0).alias("by_type"), "doc_type", "documents", "findings", share("kept"), share("unchecked"), (F.col("manual") / F.col("documents")).alias("manual_per_document"))
