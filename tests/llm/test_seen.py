import random
import unicodedata

import numpy as np
import pytest

from garimi.llm import ribbon
from garimi.llm.seen import FIELDS, SeenBefore, keys

SCHEMA_A = "archive_id long, original_sha256 string, original_filename string"
SCHEMA_R = "audit_id long, original_sha256 string, original_filename string"


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20_000])
def test_ribbon_never_misses_and_errs_at_its_rate(n):
    r = np.random.default_rng(n)
    h = r.integers(-(2**63), 2**63 - 1, n)
    f = ribbon.Ribbon.from_bytes(ribbon.build(np.concatenate([h, h])).to_bytes())
    assert f.n_keys == n and f.contains(h).all()
    other = r.integers(-(2**63), 2**63 - 1, 100_000)
    assert f.contains(other).mean() < 1.3 / 256
    assert len(f.contains(np.array([], np.int64))) == 0


def test_ribbon_retries_blocks_without_solution(monkeypatch):
    monkeypatch.setattr(ribbon, "BLOCK_KEYS", 16)
    h = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 4_000)
    assert ribbon.build(h).contains(h).all()


def brute(archive, rows):
    norm = lambda v: unicodedata.normalize("NFC", v.strip().lower()) if v and v.strip() else None
    out = set()
    for f in (1, 2):
        old = {norm(r[f]) for r in archive}
        first = {}
        for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            k = norm(r[f])
            if k is not None:
                if k in old or k in first:
                    out.add((r[0], FIELDS[f - 1]))
                first.setdefault(k, r[0])
    return out


def data(n=400):
    r = random.Random(2)
    pool = [f"파일_{i}.PDF" for i in range(150)] + ["최종본.pdf", "é.pdf", unicodedata.normalize("NFD", "한글.pdf"), "한글.PDF ", None, "", "  ", "x" * 50_000]
    pick = lambda: "뜨거운.pdf" if r.random() < 0.33 else r.choice(pool)
    archive = [(i, r.choice(pool), r.choice(pool[:60])) for i in range(60)]
    return archive, [(i * 3, pick(), pick()) for i in range(n)]


def test_found_equals_brute_force(spark):
    archive, rows = data()
    a, b = spark.createDataFrame(archive, SCHEMA_A), spark.createDataFrame(rows, SCHEMA_R).repartition(5)
    got = {(r.id, r.field) for r in SeenBefore(a, b, "archive_id", "audit_id").found().collect()}
    assert got == brute(archive, rows)
    got = {(r.id, r.field) for r in SeenBefore(a, b, "archive_id", "audit_id", batches=1).found().collect()}
    assert got == brute(archive, rows)


def test_empty_tables_and_missing_ids(spark):
    archive, rows = data(50)
    none_a, none_r = spark.createDataFrame([], SCHEMA_A), spark.createDataFrame([], SCHEMA_R)
    a, b = spark.createDataFrame(archive, SCHEMA_A), spark.createDataFrame([*rows, (None, "한글.pdf", "최종본.pdf")], SCHEMA_R)
    assert SeenBefore(a, none_r, "archive_id", "audit_id").found().count() == 0
    assert {(r.id, r.field) for r in SeenBefore(none_a, b, "archive_id", "audit_id").found().collect()} == brute([], rows)


def test_report(spark):
    archive, rows = data()
    s = SeenBefore(spark.createDataFrame(archive, SCHEMA_A), spark.createDataFrame(rows, SCHEMA_R), "archive_id", "audit_id")
    for r in s.error_report(absent=30_000).collect():
        assert r.missed == 0 and r.absent_probes == 30_000 and 0 < r.absent_yes_rate < 5 * 1.3 / 256


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A", "b", "x", 1)], SCHEMA_R + ", key string, h int")
    assert {(r.field, r.key) for r in keys(df, "audit_id").collect()} == {("original_sha256", "a"), ("original_filename", "b")}


def test_report_of_other_fields(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b")], "id long, name string")
    s = SeenBefore(df.limit(0), df, "id", "id", fields=("name",))
    assert [(r.id, r.field) for r in s.found().collect()] == [(2, "name")]
    assert [(r.field, r.distinct_keys, r.absent_probes, r.missed) for r in s.error_report(absent=500).collect()] == [("name", 3, 500, 0)]
