"""File sources and sinks: dictionaries, logs, templates, summaries, PDF files. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimi import dictionaries as D
from garimi.functions.text import strip_ws

AUDIT = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "processor", "original_filename", "original_sha256", "output_filename", "masked_counts", "rotated_text_warning", "hidden_content_warning", "review_seconds")])
CANDIDATES = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "direction", "ts")])
PROMOTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "direction", "event", "ts")])
TEMPLATES = "id string, page_count int, anchors array<array<string>>, items array<struct<type:string,page_index:int,x_bucket:int,y_bucket:int,label:string>>, sample_count int, updated_at string"
SPANS = (
    "path string, span_ord int, page_index int, text string, origin struct<x:double,y:double>, bbox struct<x0:double,y0:double,x1:double,y1:double>, "
    "fontsize double, start_pos int, end_pos int, dir struct<dx:double,dy:double>, width double, height double, has_annot boolean, has_widget boolean"
)


PDF_COLUMNS = ["path", "span_ord", "page_index", "text", "origin", "bbox", "fontsize", "start_pos", "end_pos", "dir", "width", "height", "has_annot", "has_widget"]


#: Values keep their outer white space. An empty text is written in quotation marks, a missing one as nothing.
_AS_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_READ = {**_AS_IS, "multiLine": True, "escape": '"', "nullValue": "\uffff"}  # a mark that no text holds, so that an empty one stays


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def _or_empty(spark: SparkSession, path: str, schema, read) -> DataFrame:
    """A log that doesn't exist yet is empty."""
    return read() if _exists(spark, path) else spark.createDataFrame([], schema)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a line file (``word``); blank lines and outer white space don't count. Read anew for
    each batch: a dictionary that grows is a new version of the file, never a changed global."""
    return spark.read.text(path).select(strip_ws(F.col("value")).alias("word")).filter("word <> ''").distinct()


def append_candidates(rows: DataFrame, path: str) -> None:
    rows.select(*CANDIDATES.names).write.mode("append").csv(path, header=True, escape='"', **_AS_IS)


def append_promotions(rows: DataFrame, path: str) -> None:
    rows.select(*PROMOTIONS.names).write.mode("append").csv(path, header=True, escape='"', **_AS_IS)


def make_folders(spark: SparkSession, root: str) -> dict[str, str]:
    """The folders of a workspace, made where they are missing: role to path. One that a file stands in the way
    of is an error before anything is written."""
    out = {}
    for role, name in D.FOLDERS.items():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p):
            raise OSError(f"{root}/{name} can't be made")
        out[role] = f"{root}/{name}"
    return out


def write_dictionary(words: DataFrame, path: str) -> None:
    words.select("word").write.mode("overwrite").text(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit log, typed; empty if there is none. ``"True"`` is true, anything else false."""
    raw = _or_empty(spark, path, AUDIT, lambda: spark.read.schema(AUDIT).csv(path, header=True, **_READ))
    flags = {c: F.coalesce(F.col(c) == "True", F.lit(False)) for c in ("rotated_text_warning", "hidden_content_warning")}
    return raw.withColumns(flags).withColumn("review_seconds", F.col("review_seconds").try_cast("double"))


def append_audit_log(rows: DataFrame, path: str) -> None:
    """Append rows; each part file carries its own header."""
    rows.select(*AUDIT.names).write.mode("append").csv(path, header=True, escape='"', **_AS_IS)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, path, CANDIDATES, lambda: _bom_free(spark.read.schema(CANDIDATES).csv(path, header=True, enforceSchema=True, **_READ), "word"))


def read_promotions(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, path, PROMOTIONS, lambda: _bom_free(spark.read.schema(PROMOTIONS).csv(path, header=True, enforceSchema=True, **_READ), "word"))


def _bom_free(df: DataFrame, first: str) -> DataFrame:
    return df.withColumn(first, F.regexp_replace(first, r"^\x{FEFF}", ""))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A template store; empty if there is none. A file holds a JSON list, a folder (``write_templates``) a template a line."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(p)
    return _or_empty(spark, path, TEMPLATES, lambda: spark.read.schema(TEMPLATES).json(path, multiLine=listed))


def write_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").json(path)


def write_summaries(reports: DataFrame, path: str) -> None:
    """Report texts (audit_id, report), a row each, in a table partitioned into files by Spark."""
    reports.select("audit_id", "report").write.mode("overwrite").parquet(path)


def read_pdf_spans(spark: SparkSession, path: str) -> DataFrame:
    """Text spans of PDF files, with page sizes and flags: each file is one row of the binary source, read in
    Python by PyMuPDF. Without that library this raises; all else starts from a spans table."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF; start from a spans table instead") from e

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows, at = [], 0
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for page in doc:
                        flags = (page.rect.width, page.rect.height, page.first_annot is not None, page.first_widget is not None)
                        for block in page.get_text("dict", sort=True)["blocks"]:
                            for line in block.get("lines", []):
                                for s in line["spans"]:
                                    if s["text"]:
                                        end = at + len(s["text"])
                                        rows.append((file, len(rows), page.number, s["text"], dict(zip("xy", s["origin"], strict=True)), dict(zip(("x0", "y0", "x1", "y1"), s["bbox"], strict=True)), s["size"], at, end, dict(zip(("dx", "dy"), line["dir"], strict=True)), *flags))
                                        at = end
                                at += 1  # a line ends with a newline
                        at += 1  # and so does a page
                yield pd.DataFrame(rows, columns=PDF_COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(extract, SPANS)


def batch_inputs(spark: SparkSession, path: str) -> DataFrame:
    """The text files of a folder as documents: doc_id (hash of the path), path, text. A file that can't be
    read is a row with a null text, not an error of the batch."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
