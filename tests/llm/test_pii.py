import re

import pytest

from garimi.llm import pii

GIVEN = ["가람", "누리", "하늬", "단비", "도담", "라온", "이든", "채아", "솔", "별"]
SUR = ["김", "이", "박", "최", "선우", "황보"]


def rrn(head):
    d = head + "".join(str(x) for x in range(10) if pii.check_digit(head + str(x)))[:1]
    return f"{d[:6]}-{d[6:]}"


ID1 = rrn("701016418782")
GOLD_ROWS = [
    f"민원인 {{{{김가람}}}}, 휴대폰 010-0943-8189, 메일 yeoul.nahm[at]nuri[dot]example\n주소: [[경기도 도란군 달무리길 111]]",
    "어제 {{선우하늬}} 선생이 전화하여 처리 상황을 물음.", "결과는 a1@mail.example.com으로 통보하고 사본은 {{이솔}}님께 우편으로 보냄.",
    f"신분 확인을 위해 {ID1} 대조 후 반환함.", "관리번호 680504-4884590 은 물품번호임. 버전 10.46.77 에서 재현됨. 메일은 na****@example.com 단가 38개 @ 330,490원", "참석: {{박누리}}, {{최단비}}, {{황보라온}} (이상 3명)",
    "Please contact {{Haram Seoh}} at x_y@office.example.org or +82 10 1421 8682.", "여권 R08075215 사본 접수, 명의인 {{김도담}}. Lot AB-9538 passed.", "강서 방면 도로 97m 구간 통제. 서울특별시 소재 기관 50곳에 공문 발송.",
    "카드 전표 0333 7173 3065 8901 계좌 057156-95-437062 입금. 가림 010-****-4319", "연락은 ０１０－１３０７－０４００ 또는 (010) 0785-2328 로", "", None,
]


@pytest.fixture(scope="module")
def result(spark):
    gold = spark.createDataFrame([(i, "x", t) for i, t in enumerate(GOLD_ROWS * 12)] + [(0, "x", GOLD_ROWS[0])], "case_id long, label string, marked_text string")
    names = [(i, i % 50, "이름", SUR[i % 6] + GIVEN[i % 10]) for i in range(300)] + [(900 + i, i, "이름", "Haram Seoh") for i in range(5)]
    other = [(500, 1, None, "작성자 최이든 올림"), (501, 1, "기타", "경기도 관할 사항으로 확인됨."), (502, 1, "전화번호", "010-1111-2222"), (503, 1, None, None)]
    findings = spark.createDataFrame(names + other, "finding_id long, doc_id long, type string, value string")
    texts = pii.free_texts(gold, findings)
    found = pii.Detector(texts, pii.gazetteer(findings)).found().cache()
    return texts, found, {(r.tbl, r.row_id, r.pii_type, r.start_pos): r.value for r in found.collect()}


def test_marked_names_and_addresses_are_found(result):
    _, _, got = result
    for i, marked in enumerate(GOLD_ROWS):
        if not marked:
            continue
        want, cut = set(), 0
        for m in re.finditer(r"\{\{(.*?)\}\}|\[\[(.*?)\]\]", marked):
            want.add(("이름" if m[1] else "주소", m.start() - cut, m[1] or m[2]))
            cut += 4
        assert {(k[2], k[3], v) for k, v in got.items() if k[:2] == ("gold_cases", i) and k[2] in ("이름", "주소")} == want, marked


def test_numbers(result):
    _, _, got = result
    by = lambda i: sorted((k[2], v) for k, v in got.items() if k[:2] == ("gold_cases", i) and k[2] not in ("이름", "주소"))
    assert by(0) == [("이메일", "yeoul.nahm[at]nuri[dot]example"), ("전화번호", "010-0943-8189")]
    assert by(3) == [("주민등록번호", ID1)] and by(4) == [] and by(9) == []
    assert by(6) == [("이메일", "x_y@office.example.org"), ("전화번호", "+82 10 1421 8682")] and by(7) == [("여권번호", "R08075215")]
    assert by(10) == [("전화번호", "(010) 0785-2328"), ("전화번호", "０１０－１３０７－０４００")]


def test_only_untyped_findings(result):
    _, _, got = result
    assert {k[1:] for k in got if k[0] == "findings"} == {(500, "이름", 4)}


def test_redaction_keeps_the_rest(result):
    texts, found, _ = result
    rows = {r.row_id: (r.redacted, r.n_spans) for r in pii.redact(found, texts).filter("tbl = 'gold_cases'").collect()}
    assert rows[1] == ("어제 [이름] 선생이 전화하여 처리 상황을 물음.", 1)
    assert rows[2] == ("결과는 [이메일]으로 통보하고 사본은 [이름]님께 우편으로 보냄.", 2)
    assert rows[8][1] == 0 and 11 not in rows and 12 not in rows


def test_fold_keeps_offsets():
    t, at = pii.fold("Ｍ​김 가")
    assert t == "M김 가" and at == [0, 2, 3, 4]
    (s,) = [s for s in pii.spans("여권 R‎059⁠48990 임") if s[0] == "여권번호"]
    assert (s[1], s[2]) == (3, 14)


def test_estimation_trusts_what_agrees():
    p = pii.estimate([((1, 1, 0), 400), ((1, 0, 0), 50), ((0, -1, 0), 900), ((0, 0, -1), 100), ((1, -1, 0), 5)])
    assert p[(1, 1, 0)] > 0.9 and p[(0, -1, 0)] < 0.1
    assert pii.estimate([]) == {}


def test_empty_tables(spark):
    gold = spark.createDataFrame([], "case_id long, label string, marked_text string")
    findings = spark.createDataFrame([], "finding_id long, doc_id long, type string, value string")
    texts = pii.free_texts(gold, findings)
    assert pii.Detector(texts, pii.gazetteer(findings)).found().count() == 0


def test_very_long_text():
    assert [s[0] for s in pii.spans("가" * 100_000 + " 010-1234-5678 " + "a" * 100_000)] == ["전화번호"]


def test_clashing_columns_repeats_and_long_texts(spark):
    long = "가나다 " * 30_000 + "연락처 010-1234-5678"
    gold = spark.createDataFrame([(1, "x", long, "t", 1), (1, "x", long, "t", 1), (2, "x", "전화 010-1234-5678 확인", "t", 1), (None, "x", "010-1234-5678", "t", 1)], "case_id int, label string, marked_text string, text string, row_id int")
    findings = spark.createDataFrame([(1, 1, "기타", "휴대폰 010-1111-2222", "t")], "finding_id int, doc_id int, type string, value string, tbl string")
    texts = pii.free_texts(gold, findings)
    got = sorted((r.tbl, r.row_id, r.start_pos) for r in pii.Detector(texts, pii.gazetteer(findings)).found().filter("pii_type = '전화번호'").collect())
    assert got == [("findings", 1, 4), ("gold_cases", 1, len(long) - 13), ("gold_cases", 2, 3)]


UNSEEN = ["퇴직자 {N}의 새 주소를 물었다.", "사진 속 인물은 {N}로 추정된다.", "이번 건은 {N} 주무관께서 직접 설명드렸습니다.", "차량 소유주가 {N}으로 바뀌었다.", "조회하니 {N}으로 나왔다."]


def test_known_names_in_unseen_phrasing(spark):
    """Names whose given name the gazetteer holds, in sentences that training doesn't see."""
    plain = ["{N}, 경기도 도란군 달무리길 11 거주.", "내용은 {N} 건으로 접수함.", "물품 도착 {N} 확인"]  # no cue but the name
    rows = [(i, "x", t) for i, t in enumerate(GOLD_ROWS * 12)] + [(1000 + i, "x", plain[i % 3].replace("{N}", SUR[i % 6] + GIVEN[i % 8])) for i in range(60)]
    want = {(5000 + i, UNSEEN[i % 5].index("{")) for i in range(40)}
    rows += [(5000 + i, "x", UNSEEN[i % 5].replace("{N}", SUR[i % 4] + GIVEN[i % 8])) for i in range(40)] + [(6000 + i, "x", "서류를 전부 이송하고 고지함. 강조 사항 없음.") for i in range(40)]
    gold = spark.createDataFrame(rows, "case_id long, label string, marked_text string")
    findings = spark.createDataFrame([(i, i % 50, "이름", SUR[i % 6] + GIVEN[i % 10]) for i in range(300)], "finding_id long, doc_id long, type string, value string")
    got = {(r.row_id, r.start_pos) for r in pii.Detector(pii.free_texts(gold, findings), pii.gazetteer(findings)).found().filter("pii_type = '이름' and row_id >= 5000").collect()}
    assert len(got & want) >= 0.8 * len(want) and not got - want


def test_titles_written_on(spark):
    assert [(s[1], s[2]) for s in pii.spans("김가람과장님께") if s[0] == "이름"] == [(0, 3)]
    (head,) = [s for s in pii.spans("안전과장") if s[0] == "이름" and s[2] == 2]
    assert head[3][3] == -1


def test_hot_keys_meet_a_broadcast(spark):
    keys = spark.range(3000).selectExpr("'gold_cases' as tbl", "id as row_id", "if(id % 3 = 0, 'H:가람', concat('H:', id)) as key")
    names = spark.createDataFrame([("H:가람",), ("H:7",), ("H:없음",)], "key string")
    got = {r.row_id: r.known for r in pii.known_keys(keys, names).collect()}
    assert got == {i: ["H:가람"] for i in range(0, 3000, 3)} | {7: ["H:7"]}
