import random
import unicodedata
from collections import defaultdict

from garimi.llm import frequency

SCHEMA = "event_id long, doc_id long, word string, direction string, ts string"


def brute(rows):
    seen, n, docs = {}, defaultdict(int), defaultdict(set)
    for e, d, w, k, _ in rows:
        if w and w.strip() and k is not None and (e is None or e not in seen):
            if e is not None:
                seen[e] = 1
            t = (unicodedata.normalize("NFC", w.strip()), k)
            n[t] += 1
            docs[t] |= set() if d is None else {d}
    return {t: (n[t], len(docs[t])) for t in n}


def data(n=3000):
    r = random.Random(4)
    rows = []
    for i in range(n):
        w = "통합점검반" if r.random() < 0.35 else r.choice([f"w{int(r.paretovariate(0.8)) % 400}", " 공백 ", unicodedata.normalize("NFD", "한글"), "한글", None, " "])
        rows.append((i, r.choice([None, *range(200)]), w, r.choice(["제외", "이름후보", None]), "t"))
    return rows + r.sample(rows, 200) + [(None, 1, "무번호", "제외", "t")] * 2


def test_counts_equal_brute_force(spark):
    rows = data()
    got = {(r.word, r.direction): (r.n_events, r.n_docs) for r in frequency.term_counts(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert got == brute(rows)


def test_heavy_path_is_taken_and_changes_nothing(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    assert ("통합점검반", "제외") in frequency.heavy_terms(frequency.terms(df))
    monkeypatch.setattr(frequency, "heavy_terms", lambda _: [])
    assert {(r.word, r.direction): (r.n_events, r.n_docs) for r in frequency.term_counts(df).collect()} == brute(rows)


def test_marks(spark):
    rows = [(i, i % 100, "흔함", "제외", "t") for i in range(100)] + [(200, 1, "드묾", "제외", "t")] + [(300 + i, i, "보통", "제외", "t") for i in range(4)]
    got = {r.word: r.mark for r in frequency.marked_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"흔함": "common", "드묾": "rare", "보통": None}


def test_empty(spark):
    assert frequency.marked_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    rows = [(1, 1, "가", "제외", "t", 9, 9, "x"), (2, 2, "가", "제외", "t", 9, 9, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", n_events int, which int, mark string")
    assert [(r.word, r.n_events, r.n_docs) for r in frequency.marked_counts(df).collect()] == [("가", 2, 2)]


def test_no_heavy_row_is_shuffled(spark):
    """What the heavy arm exchanges are packed sets, whatever the number of rows; sparse and dense ids."""
    rows = [(e, d, 0) for e, d in [*((i, i % 5000) for i in range(70_000)), (2**40, 2**50), (-7, -7), (None, 3), (None, None)]] * 2
    df = spark.createDataFrame(rows, "event_id long, doc_id long, which int")
    got = frequency.heavy_counts(df).first()
    assert (got.n_events, got.n_docs) == (70_002 + 4, 5000 + 2)
    assert frequency.heavy_counts(df.limit(0)).count() == 0
    plan = frequency.heavy_counts(df)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "MapInArrow" in first and "ids" in first


def test_heavy_rows_are_packed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(frequency, "LOCAL_ROWS", 10)
    rows = [(i % 30, i % 7, 0) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, doc_id long, which int").repartition(3)
    assert tuple(frequency.heavy_counts(df).first()) == (0, 30, 7)
