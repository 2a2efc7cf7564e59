import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimi.llm import packing


def expand(groups):
    """Every container's items, by rank."""
    bins = []
    for g in groups:
        for i in range(g.count):
            bins.append((g.capacity, [(size, rank + i * each + k) for size, each, rank in g.slots for k in range(each)]))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=25), st.sampled_from([[100], [30, 100], [10, 50, 100]]))
def test_best_fit_places_every_item_once(histogram, capacities):
    bins = expand(packing.best_fit(histogram, capacities))
    placed = sorted(x for _, items in bins for x in items)
    assert placed == sorted((s, i) for s, n in histogram.items() for i in range(n))
    for capacity, items in bins:
        used = sum(s for s, _ in items)
        assert used <= capacity and capacity == min(c for c in sorted(capacities) if c >= used)


def plain_bfd(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_as_good_as_item_by_item():
    r = random.Random(1)
    for _ in range(20):
        sizes = [r.randrange(1, 200) for _ in range(300)]
        histogram = defaultdict(int)
        for s in sizes:
            histogram[s] += 1
        assert sum(g.count for g in packing.best_fit(histogram, [200])) == plain_bfd(sizes, 200)


def test_counts_do_not_matter_for_cost():
    groups = packing.best_fit({s: 10**9 for s in range(1, 400)}, [512])
    assert len(groups) <= 4 * 400 and sum(g.count * sum(e for s, e, _ in g.slots if s == 7) for g in groups) == 10**9


CONTAINERS = [("small", 10), ("standard", 40), ("large", 160), (None, None), ("zero", 0)]


@pytest.fixture(scope="module")
def containers(spark):
    return spark.createDataFrame(CONTAINERS, "container_kind string, capacity_tokens long")


def test_pack(spark, containers, monkeypatch):
    monkeypatch.setattr(packing, "PARTS_A_SALT", 20)
    r = random.Random(2)
    sizes = {i: 7 if r.random() < 0.35 else r.choice([0, 1, 5, 9, 10, 11, 39, 40, 41, 160, 161, 333, r.randrange(200)]) for i in range(500)}
    df = spark.createDataFrame([(i, n) for i, n in sizes.items()] + [(900, None), (901, 12), (901, 12)], "doc_id long, n_tokens long").repartition(7)
    rows = packing.pack(df, containers).collect()
    assert {x.plan for x in rows} == {"small", "standard", "large", "joint"}
    for plan, cap in (("small", 10), ("standard", 40), ("large", 160), ("joint", 160)):
        mine = [x for x in rows if x.plan == plan]
        parts, bins = defaultdict(list), defaultdict(list)
        for x in mine:
            parts[x.doc_id].append(x)
            bins[x.bin_id].append(x)
        assert set(parts) == set(sizes) | {900, 901}
        for d, ps in parts.items():
            if d == 901:
                continue
            n = sizes.get(d, 0)
            assert sum(p.n_tokens for p in ps) == n and len(ps) == ps[0].n_parts == max(1, -(-n // cap))
            assert sorted(p.start_token for p in ps) == [k * cap for k in range(len(ps))]
        for content in bins.values():
            used = sum(x.n_tokens for x in content)
            assert used <= content[0].capacity_tokens and len({(x.capacity_tokens, x.container_kind) for x in content}) == 1
        if plan == "joint":
            assert len({x.container_kind for x in mine}) > 1
        assert sorted(bins) == list(range(len(bins)))
    report = {(r.plan, r.container_kind): r.filled for r in packing.fill_report(packing.pack(df, containers)).collect()}
    assert report[("large", "large")] > 0.95


def test_only_empty_documents(spark, containers):
    rows = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long"), containers).collect()
    assert {(r.plan, r.bin_id, r.n_tokens) for r in rows} == {(p, 0, 0) for p in ("small", "standard", "large", "joint")}


def test_no_documents_and_no_containers(spark, containers):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(none, containers).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, containers.filter("false"))
