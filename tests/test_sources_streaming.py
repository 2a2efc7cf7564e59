import pytest
from pyspark.sql import functions as F

from garimi.sources import files
from garimi.streaming import ingest


def test_dictionary_round_trip(spark, tmp_path):
    p = tmp_path / "words.txt"
    p.write_text(" 김 \n\n이\n김\n", encoding="utf-8")
    words = files.read_dictionary(spark, str(p))
    assert {r.word for r in words.collect()} == {"김", "이"}
    files.write_dictionary(words, str(tmp_path / "out"))
    assert files.read_dictionary(spark, str(tmp_path / "out")).count() == 2


def test_logs(spark, tmp_path):
    assert files.read_audit_log(spark, str(tmp_path / "none.csv")).count() == 0
    p = tmp_path / "log.csv"
    p.write_text("timestamp,processor,original_filename,original_sha256,output_filename,masked_counts,rotated_text_warning,hidden_content_warning,review_seconds\nt,p,a.pdf,h,o.pdf,이름:1,True,False,12.3\n", encoding="utf-8")
    r = files.read_audit_log(spark, str(p)).first()
    assert (r.rotated_text_warning, r.hidden_content_warning, r.review_seconds) == (True, False, 12.3)
    files.append_audit_log(files.read_audit_log(spark, str(p)), str(tmp_path / "logs"))
    files.append_audit_log(files.read_audit_log(spark, str(p)), str(tmp_path / "logs"))
    assert files.read_audit_log(spark, str(tmp_path / "logs")).count() == 2
    c = tmp_path / "c.csv"
    c.write_text("﻿word,direction,ts\n가,제외,2033-01-01T00:00:00\n", encoding="utf-8")
    assert [tuple(x) for x in files.read_candidates(spark, str(c)).collect()] == [("가", "제외", "2033-01-01T00:00:00")]
    assert files.read_templates(spark, str(tmp_path / "t.json")).count() == 0
    (tmp_path / "t.json").write_text('[{"id": "a", "page_count": 1,\n "anchors": [[0, "성명", 1, 2]], "items": [], "sample_count": 3}, {"id": "b"}]', encoding="utf-8")
    store = files.read_templates(spark, str(tmp_path / "t.json"))
    assert [(r.id, r.anchors) for r in store.collect()] == [("a", [["0", "성명", "1", "2"]]), ("b", None)]
    files.write_templates(store, str(tmp_path / "store"))
    assert files.read_templates(spark, str(tmp_path / "store")).count() == 2


def test_logs_keep_values_as_they_are(spark, tmp_path):
    rows = [(" 가 ", "제외", 'a"b'), ("", None, "x\ny"), (None, "", ",")]
    files.append_candidates(spark.createDataFrame(rows, files.CANDIDATES), str(tmp_path / "c"))
    assert {tuple(r) for r in files.read_candidates(spark, str(tmp_path / "c")).collect()} == set(rows)


def test_folders(spark, tmp_path):
    made = files.make_folders(spark, f"file://{tmp_path}/ws")
    assert set(made) == {"originals", "masked", "reports", "logs"} and (tmp_path / "ws" / "로그").is_dir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "로그").write_text("x")
    with pytest.raises(Exception):
        files.make_folders(spark, f"file://{tmp_path}/bad")


def test_pdf_source_needs_its_library(spark):
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            files.read_pdf_spans(spark, "/nowhere")


def test_batch_inputs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("성명: 김철수", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.batch_inputs(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "성명: 김철수", "b.txt": None}


def test_publish_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "성명: 김철수 010-1234-5678"), (2, "없음"), (3, None)], "doc_id long, text string")
    for _ in range(2):
        ingest.publish(docs, str(tmp_path), 7)
    audit = spark.read.parquet(f"{tmp_path}/audit").collect()
    assert [(r.doc_id, r.masked_counts) for r in audit] == [(1, "이름:1;전화번호:1")]
    assert spark.read.parquet(f"{tmp_path}/masked").count() == 2
    assert all("김철수" not in str(r) for r in audit)


def test_publish_blocks_residue_and_unclean_hidden(spark, tmp_path):
    rows = [(1, "성명: 김철수\n작성 김철수", []), (2, "성명: 김철수", ["성명: 이영희, 이영희 확인"]), (3, "성명: 김철수", ["성명: 이영희", None]), (4, "성명: 박민수", None)]
    ingest.publish(spark.createDataFrame(rows, "doc_id long, text string, hidden array<string>"), str(tmp_path), 1)
    got = {r.doc_id: r.hidden for r in spark.read.parquet(f"{tmp_path}/masked").collect()}
    assert got == {3: ["성명: 이*희", None], 4: None}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/audit").collect()} == {3, 4}


def test_mask_stream(spark, tmp_path):
    spark.createDataFrame([(1, "성명: 김철수")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    ingest.mask_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/masked").first().masked == "성명: 김*수"


def test_learn_stream(spark, tmp_path):
    schema = "word string, direction string, ts string, event string"
    rows = [("가", "제외", f"2033-01-0{i}", None) for i in (1, 2, 3)] + [("나", "제외", "2033-01-01", None), ("가", "제외", "2033-01-04", "취소"), ("가", "제외", "2033-01-05", None), (None, "제외", "2033-01-01", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/ev")
    q = ingest.learn_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev")).writeStream.format("memory").queryName("learned").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted((r.word, r.event) for r in spark.table("learned").collect()) == [("가", "반영"), ("가", "취소")]


def test_nfc_agrees_with_python(spark):
    import unicodedata

    from garimi.functions.text import nfc, strip_ws

    texts = ["가나", "한", "é", "Å", "abc", "", None, "例", "á̧", "　x "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfc(F.col("t")).alias("n"), strip_ws(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.n == (None if r.t is None else unicodedata.normalize("NFC", r.t))
        assert r.s == (None if r.t is None else r.t.strip())
