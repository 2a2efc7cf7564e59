import pytest
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.functions.offsets import literal_occurrences, occurrences
from garimi.operators import detect

GOLDEN = (
    "지출결의서\n신청인: 김테스트 (010-1234-5678)\n주민등록번호: 900101-1234568\n입금계좌: 국민은행 123456-04-789012 (예금주: 김테스트)\n이메일: test.dummy@example.com\n"
    "주소: 서울특별시 강남구 테헤란로 123\n연락처: 010-9999-8888 (담당: 최민수)\n성명: 김철수\n성명: 삼식이\n기안자: 이감사 / 검토: 박팀장 / 결재: 최과장\n"
)
EXPECTED = [
    ("이름", "김테스트", 11, 15, "기본", "중간", False), ("전화번호", "010-1234-5678", 17, 30, "기본", "높음", False), ("주민등록번호", "900101-1234568", 40, 54, "기본", "높음", False),
    ("계좌번호", "123456-04-789012", 66, 82, "기본", "높음", False), ("이름", "김테스트", 89, 93, "기본", "중간", False), ("이메일", "test.dummy@example.com", 100, 122, "기본", "높음", False),
    ("주소", "서울특별시 강남구 테헤란로 123", 127, 145, "기본", "낮음", False), ("전화번호", "010-9999-8888", 151, 164, "기본", "높음", False), ("이름", "최민수", 170, 173, "기본", "높음", True),
    ("이름", "김철수", 179, 182, "기본", "중간", False), ("이름", "삼식이", 187, 190, "교차검증후보", "낮음", True), ("이름", "이감사", 196, 199, "업무상성명후보", "낮음", False),
    ("이름", "박팀장", 206, 209, "업무상성명후보", "낮음", False), ("이름", "최과장", 216, 219, "업무상성명후보", "낮음", False),
]


def run(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in detect.findings(df).orderBy("doc_id", "emit_ord").collect():
        out[r.doc_id].append((r.type, r.value, r.start_pos, r.end_pos, r.grp, r.confidence, r.cross_validated))
    return [out[i] for i in range(len(texts))]


def test_golden_document(spark):
    assert run(spark, GOLDEN) == [EXPECTED]


CASES = {
    "주민등록번호: 900101-1234569": [],
    "011-123-4567": [("전화번호", "011-123-4567")], "01012345678": [("전화번호", "01012345678")], "015-1234-5678": [], "02-1234-5678": [],
    "여권번호: m12345678 입니다": [], "여권번호: M12345678 입니다": [("여권번호", "M12345678")],
    "계좌: 123456-04-789012": [("계좌번호", "123456-04-789012")], "계좌" + " " * 20 + "123456-04-789012": [], "계좌번호\n123456-04-789012": [], "계좌: 010-1234-5678": [("전화번호", "010-1234-5678")],
    "담당: 국민은행": [], "담당: 감사팀": [], "성명: 남궁민지": [("이름", "남궁민지")], "감사팀장 홍길동 배석": [("이름", "홍길동")], "주소: 서울": [], "성명:\n김철수": [("이름", "김철수")],
    "주소:\n서울특별시 강남구 1": [("주소", "서울특별시 강남구 1")], "담당자: 김철수": [], "성명: 서인천지사": [("이름", "서인천지")], "성명: 김철수\n성명: 감사팀": [("이름", "김철수"), ("이름", "감사팀")],
    "계좌 123-010-1234-5678": [("계좌번호", "123-010-1234"), ("전화번호", "010-1234-5678")], "카드번호 1234-5678-9012-3456": [("카드번호", "1234-5678-9012-3456")],
    "주소: 서울특별시 *** ****": [("주소", "서울특별시 *** ****")], "성명　：　김철수": [("이름", "김철수")], "연락처０１０": [], "": [],
}


def test_edge_cases(spark):
    got = run(spark, *CASES)
    for text, found in zip(CASES, got, strict=True):
        if text == "계좌 123-010-1234-5678":
            assert [f[0] for f in found] == ["계좌번호", "전화번호"] and found[1][1] == "010-1234-5678"
        else:
            assert [f[:2] for f in found] == CASES[text], text


def test_null_text_and_long_text(spark):
    long = "가" * 200_000 + " 010-1234-5678"
    a, b = run(spark, None, long)
    assert a == [] and b[0][2] == 200_001


def test_line_is_bumped_once(spark):
    (f,) = run(spark, "연락처: 010-1111-2222 연락처: 010-3333-4444 기안: 이감사")
    assert [x[5] for x in f if x[0] == "이름"] == ["중간"]


def test_hints(spark):
    df = spark.createDataFrame([("메모: 123456-04-789012",), ("주민 900101-1234569",), ("계좌: 123456-04-789012",)], "text string")
    rows = [[h.type for h in r.h] for r in df.select(detect.hints(F.col("text"), detect.detect_all(F.col("text"))).alias("h")).collect()]
    assert rows == [["계좌번호(추정)"], ["주민등록번호(추정)"], []]


def test_classify(spark):
    values = {"010-1234-5678": D.PHONE, "a@b.com": D.EMAIL, "900101-1234568": D.RRN, "900101-1234569": D.OTHER, "123456-04-789012": D.ACCOUNT, "M12345678": D.PASSPORT, "홍길동": D.NAME, "감사팀": D.OTHER, "서울 강남": D.ADDRESS, "": D.OTHER, "1234567890123456": D.CARD, "010-1234-5678\n": D.OTHER}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    assert {r.v: r.k for r in df.select("v", detect.classify(F.col("v")).alias("k")).collect()} == values | {None: None}


@pytest.mark.parametrize("text,pattern", [("😀가 12 34", "[0-9]+"), ("", "a"), ("aaa", "a"), ("ab", "c"), ("12가12", "[0-9]{2}")])
def test_occurrences_equal_finditer(spark, text, pattern):
    import re

    got = spark.createDataFrame([(text,)], "t string").select(occurrences(F.col("t"), pattern).alias("o")).first().o
    assert [(o.value, o.start_pos, o.end_pos) for o in got] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, text)]


def test_literal_occurrences(spark):
    rows = [("a.b a.b axb", "a.b", [0, 4]), ("\\Ex\\E", "\\E", [0, 3]), ("aaa", "aa", [0]), ("x", "", []), ("x", None, []), ("(a)(a)", "(a)", [0, 3])]
    df = spark.createDataFrame([(t, v) for t, v, _ in rows], "t string, v string")
    got = [[o.start_pos for o in r.o] for r in df.select(literal_occurrences(F.col("t"), F.col("v")).alias("o")).collect()]
    assert got == [w for *_, w in rows]


def test_learned_words(spark):
    from garimi.operators import learning

    standing = spark.createDataFrame([("뷁", "이름후보"), ("김철수", "제외"), ("x", "다른")], "word string, direction string")
    words = learning.learned_words(spark, standing)
    docs = spark.createDataFrame([(1, "성명: 뷁가람\n담당: 김철수\n예금주: 이감사\n")], "doc_id long, text string")
    assert [r.value for r in detect.findings(docs, words).orderBy("start_pos").collect()] == ["뷁가람", "이감사"]
    assert [r.value for r in detect.findings(docs).orderBy("start_pos").collect()] == ["김철수", "이감사"]


def test_running_and_among(spark):
    from garimi.functions.offsets import among, running

    rows = [(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000)]
    df = spark.createDataFrame(rows, "x array<int>").select("x", running(F.col("x")).alias("s"), running(F.col("x"), most=True).alias("m"), among(F.col("x"), F.array(F.lit(3), F.lit(64))).alias("h"))
    for r in df.collect():
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] and r.m == r.x and r.h == [v in (3, 64) for v in r.x]
