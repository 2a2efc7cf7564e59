import pytest

from garimi.llm import mojibake as m

CLEAN = ["민원접수증 문서번호 제2031호 담당부서 홍보편집실 성명 김철수 주소 서울", "카드번호 결제 내역은 다음과 같다. 계약을 체결하였다. ① 예산 ② 집행", "Café résumé naïve — “quoted” §12 ±3", "MAÇÃ, PÃO e ÂMBAR INFORMAÇÃO Nº 3", "林松竹 金星正 盧水松", "Проверка Ελληνικά 見積書", "뷁톤산업과 협의"]
LINE = "문서번호 담당부서 성명 주소 카드번호"


def garble(text, write, read, errors="strict"):
    return text.encode(write).decode(read, errors)


BAD = {
    "utf8-cp1252": "".join(m.chains()["utf-8>cp1252:kept"](LINE)), "utf8-latin1": garble(LINE, "utf-8", "latin-1"), "cp949-latin1": garble(LINE, "cp949", "latin-1"), "utf8-mac": garble(LINE, "utf-8", "mac_roman"),
    "utf8-cp949": garble(LINE, "utf-8", "cp949", "replace"), "cp949-gbk": garble(LINE, "cp949", "gbk", "replace"), "utf8-cp437": garble(LINE, "utf-8", "cp437"), "utf8-cp1251": m.chains()["utf-8>cp1251:kept"](LINE),
    "twice": m.chains()["utf-8>cp1252>utf-8>cp1252"](LINE), "stripped": m.chains()["utf-8>latin-1:stripped"](LINE), "part": "정상 문장이 앞에 있다.\n" + garble("담당부서: 홍보편집실", "utf-8", "latin-1") + "\n끝", "symbol": "price Â§12 Â±3",
    "unknown name": garble("허깔뱀", "utf-8", "latin-1"), "accents": "CafÃ© rÃ©sumÃ©",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 4)] + [(100 + i, t) for i, t in enumerate(BAD.values())] + [(200, None), (201, ""), (202, " "), (203, "plain ascii"), (204, "성명 " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_found(docs):
    got = {r.doc_id for r in m.garbled(docs).select("doc_id").collect()}
    assert {list(BAD)[i - 100] for i in got if 100 <= i < 200} == set(BAD)
    assert not [i for i in got if i < 100 or i >= 200]


def test_restored(docs):
    got = {list(BAD)[r.doc_id - 100]: r.text for r in m.restored(docs).collect()}
    for name in ("utf8-cp1252", "utf8-latin1", "cp949-latin1", "utf8-mac", "utf8-cp949", "cp949-gbk", "utf8-cp437", "utf8-cp1251", "twice", "stripped"):
        assert got[name] == LINE, name
    assert got["part"] == "정상 문장이 앞에 있다.\n담당부서: 홍보편집실\n끝" and got["unknown name"] == "허깔뱀" and got["symbol"] == "price §12 ±3"


def test_forms_and_undo():
    assert "ì„±ëª…" in m.forms("성명") and m.undo("ì„±ëª…")[0] == "성명"
    assert m.undo("ÇÃ") is None and m.undo("林松竹") is None


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert m.garbled(none).count() == 0 and m.restored(none).count() == 0


def test_clashing_columns_repeats_and_types(spark):
    rows = [(i, "성명: 김철수", "x", 1) for i in range(5)] + [(9, "성명".encode().decode("latin-1"), "x", 1)] * 2 + [(None, "성명".encode().decode("latin-1"), "x", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, token string, n_docs int")
    assert [r.doc_id for r in m.garbled(df).collect()] == [9]
    assert [(r.doc_id, r.text) for r in m.restored(df).collect()] == [(9, "성명")] * 2


def test_garbled_outnumbers_clean(spark):
    """One garbled text in most rows, and a source that is garbled as a whole: each word stands clean in one row only."""
    line = "예산 집행 내역과 계약을 체결하였다"
    for chain in ("utf-8>cp949:replace", "utf-8>latin-1:stripped", "cp949>gbk:replace", "cp949>latin-1:kept"):
        bad = " ".join(m.chains()[chain](w) for w in line.split())
        rows = [(0, line), (1, "臾 林松竹 金星正"), (2, "다른 문장")] + [(10 + i, bad) for i in range(6)] + [(20 + i, f"{bad} {i}") for i in range(6)]
        got = {r.doc_id: r.text for r in m.restored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {10 + i: line for i in range(6)} | {20 + i: f"{line} {i}" for i in range(6)}, chain


def test_long_runs(spark):
    """Runs of more than 60 characters, one of them a text without ASCII spaces, garbled by chains that lose bytes."""
    runs = ["".join(chr(0xAC00 + i * 7) for i in range(1200)), "個人情報の取扱いについて、次の通り定める。　本規程は全社員に適用する。" * 3, "가나" * 12_000]
    rows, want = [(i, r) for i, r in enumerate(runs)], {}
    for i, r in enumerate(runs):
        for j, chain in enumerate(("utf-8>cp949:replace", "utf-8>cp949:ignore", "utf-8>latin-1:stripped")):
            rows.append((100 + 10 * i + j, "끝 " + m.chains()[chain](r)))
            want[100 + 10 * i + j] = "끝 " + r
    got = {r.doc_id: r.text for r in m.restored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_plain_hangul_forms(spark):
    """Words whose garbled forms are Hangul alone: restored beside others, and found where nothing else stands."""
    chain = m.chains()["utf-8>cp949:ignore"]
    words = ["용산", "예산", "용역", "성명", "주소"]
    assert [chain(w) for w in words[:3]] == ["슜궛", "삁궛", "슜뿭"]
    rows = [(i, " ".join(words)) for i in range(3)] + [(10, " ".join(map(chain, words))), (11, "앞 문장\n" + chain("예산")), (12, f"{chain('용산')} {chain('용역')}"), (13, "뷁톤산업 협의")]
    got = {r.doc_id: r.text for r in m.restored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10: " ".join(words), 11: "앞 문장\n예산", 12: "용산 용역"}


def test_lost_beyond_recognition(spark):
    """A passage of which replacement characters alone came out is found; nothing is put in its place."""
    lost = "예산".encode("cp949").decode("utf-8", "replace")
    assert set(lost) == {"�"} and m.forms("예산")[lost] == "cp949>utf-8:replace"
    rows = [(i, "예산 집행 내역") for i in range(3)] + [(9, f"앞 문장 {lost} 뒤"), (10, "한 글자 � 뿐")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_repaired, r.n_left) for r in m.restored(df).collect()}
    assert got[9] == (f"앞 문장 {lost} 뒤", 0, 1) and not set(got) - {9, 10}


def test_bulk_forms_equal_single_ones():
    words = ["예산", "집행내역을", "Café", "見積書", "�x", "뷁", "①②", "😀가"]
    bulk = {}
    for i, form, name in m._forms(words):
        bulk.setdefault(words[i], {})[form] = name
    for w in words:
        assert bulk.get(w, {}) == m.forms(w)
        for form, name in m.forms(w).items():
            assert m.chains()[name](w) == form
