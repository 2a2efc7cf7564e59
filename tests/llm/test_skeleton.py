import itertools
import unicodedata

import pytest

from garimi.llm import skeleton

SAME = [("ＡＢ-1", "AB-1"), ("Ｏｈｍ", "Ohm"), ("é", "é"), ("한글", unicodedata.normalize("NFD", "한글")), ("a​b﻿", "ab"), ("김 철", "김 철"), ("김　철", "김 철"), ("раik", "paik"), ("Ѕеоh", "Seoh"), ("Αgnеѕ", "Agnes"), ("010‑12", "010-12"), ("010–12", "010−12"), ("010－12", "010-12"), ("金", "金"), ("­", ""), ("ﾊﾞ", "バ"), ("Ⅳ", "IV"), ("ﬁle", "file"), ("ꓢеоⲥ", "Seoc")]
DIFFERENT = [("a", "A"), ("é", "e"), ("김 철", "김철"), ("1", "l"), ("0", "O"), ("l", "I"), ("①", "1"), ("㈜", "(주)"), ("ø", "o"), ("가", "각"), ("a b", "a  b")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert skeleton.skeleton(a) == skeleton.skeleton(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


def test_idempotent():
    for a, b in SAME + DIFFERENT:
        for s in (a, b):
            assert skeleton.skeleton(skeleton.skeleton(s)) == skeleton.skeleton(s)


def test_ascii_is_its_own_prototype():
    text = "".join(map(chr, range(128)))
    assert skeleton.skeleton(text) == text and not any(k < 128 for k in skeleton.prototypes())


def test_pairs_equal_brute_force(spark):
    values = ["김철수", "김​철수", "김 철수", "Ohm", "Оhm", "Ｏhm", None, "", "​", "x" * 9999, "Ohm"]
    rows = [(i, i % 2, v) for i, v in enumerate(values * 3)] + [(0, 0, values[0]), (99, None, "Ohm"), (None, 0, "Оhm")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "id long, doc_id long, v string, look string, a int")
    got = sorted((r.tbl, r.id_a, r.id_b) for r in skeleton.same_look_pairs(df, "id", "v", "t").collect())
    once = [r for r in dict.fromkeys(rows) if None not in r]
    want = sorted(("t", *sorted((a[0], b[0]))) for a, b in itertools.combinations(once, 2) if a[1] == b[1] and a[2] != b[2] and skeleton.skeleton(a[2]) == skeleton.skeleton(b[2]))
    assert got == want and want


def test_canonical_form(spark):
    df = spark.createDataFrame([(1, 1, "Оｈm​"), (2, 1, None), (3, 1, unicodedata.normalize("NFD", "한글"))], "id long, doc_id long, v string")
    got = {r.id: (r.canonical, r.changed) for r in skeleton.canonical(df, "id", "v", "t").collect()}
    assert got == {1: ("Ohm", True), 2: (None, False), 3: ("한글", True)}


def test_classes_equal_brute_force(spark):
    values = ["김철수", "김​철수", "김 철수", "Ohm", "Оhm", "Ｏhm", None, "", "​", "Ohm"]
    rows = [(i, i % 2, v) for i, v in enumerate(values * 3)] + [(0, 0, values[0]), (99, None, "Ohm"), (None, 0, "Оhm")]
    df = spark.createDataFrame(rows, "id long, doc_id long, v string")
    once = [r for r in dict.fromkeys(rows) if r[0] is not None]
    want = {}
    for i, d, v in once:
        alike = [r for r in once if d is not None and v is not None and r[1] == d and r[2] is not None and skeleton.skeleton(r[2]) == skeleton.skeleton(v)]
        want[i] = (min([r[0] for r in alike], default=i), sum(r[2] != v for r in alike))
    got = {r.id: (r.class_id, r.n_links) for r in skeleton.same_look_classes(df, "id", "v", "t").collect()}
    assert got == want
    links = [x for r in skeleton.same_look_pairs(df, "id", "v", "t").collect() for x in (r.id_a, r.id_b)]
    assert all(links.count(i) == n for i, (_, n) in want.items())
    assert skeleton.same_look_classes(df.limit(0), "id", "v", "t").count() == 0 and skeleton.same_look_pairs(df.limit(0), "id", "v", "t").count() == 0


def test_many_copies_of_one_string(spark):
    """A million equal strings and one variant give a million pairs, without comparing copies."""
    df = spark.range(1_000_000).selectExpr("id", "1L as doc_id", "if(id = 7, 'Оhm', 'Ohm') as v")
    got = skeleton.same_look_pairs(df, "id", "v", "t").selectExpr("count(*) n", "count_if(id_a = 7 or id_b = 7) k").first()
    assert (got.n, got.k) == (999_999, 999_999)
