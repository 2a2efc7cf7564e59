from pyspark.sql import functions as F

from garimi.functions import masking as M
from garimi.operators import detect, verify

GOLDENS = [
    ("이름", "홍길동", "홍*동"), ("이름", "윤아", "윤*"), ("전화번호", "010-9999-8888", "010-****-8888"), ("전화번호", "01012345678", "010****5678"), ("이메일", "a@b.com", "*@b.com"), ("이메일", "abc@test.com", "ab*@test.com"),
    ("계좌번호", "123456-04-789012", "******-**-**9012"), ("카드번호", "1234567890123456", "1234********3456"), ("주민등록번호", "900101-1234568", "900101-*******"), ("주민등록번호", "12345-123456", "*****-******"),
    ("여권번호", "M12345678", "*********"), ("주소", "서울특별시 강남구 1", "서울특별시 *** *"), ("기타", "아무 것", "****"), (None, "ab", "**"), ("이름", None, None), ("이름", "", ""), ("카드번호", "12-34", "12-34"), ("주소", "서울", "**"),
]


def test_goldens(spark):
    df = spark.createDataFrame(GOLDENS, "t string, v string, want string")
    for r in df.select("*", M.mask_value(F.col("t"), F.col("v")).alias("got")).collect():
        assert r.got == r.want, r


def test_full_policy(spark):
    df = spark.createDataFrame([("계좌번호", "12-34"), ("주민등록번호", "900101-1234568")], "t string, v string")
    got = [r[0] for r in df.select(M.mask_value(F.col("t"), F.col("v"), M.Policy(True, True))).collect()]
    assert got == ["**-**", "******-*******"]


def test_text_mask_keeps_length_and_order(spark):
    texts = ["계좌 123-010-1234-5678 끝", "성명: 김철수 010-1234-5678", "없음", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.masked for r in verify.masked(df).collect()}
    assert all(len(rows[i]) == len(t) for i, t in enumerate(texts))
    assert rows[1] == "성명: 김*수 010-****-5678" and rows[2] == "없음" and rows[3] == ""
    assert verify.leftovers(verify.masked(df)).count() == 0


def test_hidden_content(spark):
    rows = [(1, "annot", 0, "메모: 실제 연락처는 010-9999-8888 입니다"), (1, "embfile", 0, "주민번호: 900101-1234568"), (1, "widget", 0, "010-5555-6666"), (2, "annot", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, ord int, content string")
    got = {(r.doc_id, r.kind): r.masked for r in verify.scrub_hidden(df).collect()}
    assert got[(1, "annot")].endswith("010-****-8888 입니다") and got[(1, "embfile")] == "주민번호: 900101-*******" and got[(1, "widget")] == "010-****-6666" and got[(2, "annot")] is None


def test_gate_blocks_stale_spans(spark):
    docs = spark.createDataFrame([(1, "성명: 김철수"), (2, "없음")], "doc_id long, text string")
    f = spark.createDataFrame([(1, 1, "이름", "김철수", 4, 7, True), (2, 2, "이름", "김철수", 0, 3, True)], "finding_id long, doc_id long, type string, value string, start_pos int, end_pos int, approved boolean")
    plan = verify.redaction_plan(f, docs)
    assert {r.finding_id: r.mapped for r in plan.collect()} == {1: True, 2: False}
    none = verify.scrub_hidden(spark.createDataFrame([], "doc_id long, kind string, ord int, content string"))
    gate = {r.doc_id: r.publish for r in verify.gate(plan, verify.checks(verify.masked(docs)), none, docs).collect()}
    assert gate == {1: True, 2: False}


def test_gate_blocks_residue_and_unclean_hidden_content(spark):
    """A value that stands once more where no rule looks, in the text or in a hidden string, blocks the document."""
    docs = spark.createDataFrame([(1, "성명: 김철수\n작성 김철수\n"), (2, "성명: 김철수"), (3, "성명: 김철수"), (4, None)], "doc_id long, text string")
    hidden = spark.createDataFrame([(2, "annot", 0, "성명: 이영희, 이영희 확인"), (3, "annot", 0, "성명: 이영희"), (3, "annot", 1, None)], "doc_id long, kind string, ord int, content string")
    plan = verify.redaction_plan(spark.createDataFrame([], "finding_id long, doc_id long, type string, value string, start_pos int, end_pos int, approved boolean"), docs)
    got = {r.doc_id: (r.residue, r.unclean_hidden, r.publish) for r in verify.gate(plan, verify.checks(verify.masked(docs)), verify.scrub_hidden(hidden), docs).collect()}
    assert got == {1: (1, 0, False), 2: (0, 1, False), 3: (0, 0, True), 4: (0, 0, True)}
    residue = {r.doc_id for r in verify.byte_residue(verify.masked(docs)).collect()}
    assert residue == {1} and not any(got[i][2] for i in residue)


def test_overlaid_equals_one_mask_at_a_time():
    import random

    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("abcdef") for _ in range(r.randrange(1, 25)))
        spans = sorted((r.randrange(len(text)), r.randrange(1, 6)) for _ in range(r.randrange(6)))
        spans = [(a, min(n, len(text) - a)) for a, n in spans]
        masks = ["*" * (n - 1) + str(i) for i, (_, n) in enumerate(spans)]
        want = text
        for k in sorted(range(len(spans)), key=lambda k: (-spans[k][0], k)):
            a, n = spans[k]
            want = want[:a] + masks[k] + want[a + n :]
        assert M.overlaid(text, [a for a, _ in spans], [n for _, n in spans], masks) == want


def test_values_looked_for_at_once():
    text = "가나다 " * 50 + "끝"
    values = [f"값{i}" for i in range(90)] + ["나다", "끝", "다 가", "끝끝"]
    assert M.held_values(text, values) == [v in text for v in values]


def test_long_document_is_linear(spark):
    """50,000 lines with four findings each: found, masked and checked within seconds."""
    import time

    line = "성명: 김철수 연락처: 010-1234-5678 기안: 이감사 a.b@c.example\n"
    docs = spark.createDataFrame([(1, line * 50_000)], "doc_id long, text string")
    t = time.time()
    r = verify.checks(verify.masked(docs)).first()
    assert (r.left_over, r.residue) == (0, 0) and time.time() - t < 60


def test_masked_address_is_found_again(spark):
    docs = spark.createDataFrame([(1, "주소: 서울특별시 강남구 1")], "doc_id long, text string")
    assert [r.type for r in verify.redetected(verify.masked(docs)).collect()] == ["주소"]
    assert detect.findings(docs).count() == 1
