import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidewrack.llm import packing as P


def check(rows, sizes, capacity):
    """Every document is whole or cut because it had to be, nothing overlaps, nothing overflows."""
    by, held = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert (r.container is None) == (r.size == 0)
        if r.size:
            held.setdefault(r.container, []).append((r.place, r.size))
    assert set(by) == set(sizes)
    for doc, parts in by.items():
        assert sum(p.size for p in parts) == sizes[doc]
        assert len(parts) == max(1, -(-sizes[doc] // capacity))
        assert sorted(p.start for p in parts) == [i * capacity for i in range(len(parts))]
    for spans in held.values():
        end = 0
        for place, size in sorted(spans):
            assert place == end
            end += size
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("capacity,seed", [(100, 1), (64, 2), (7, 3), (1, 4)])
def test_all_documents_fit(spark, capacity, seed):
    rng = np.random.default_rng(seed)
    sizes = {i: int(n) for i, n in enumerate(np.concatenate([rng.integers(0, capacity + 1, 300), rng.integers(1, 4 * capacity, 40), np.full(150, max(1, capacity // 3))]))}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").repartition(5)
    used = check(P.pack(df, capacity).collect(), sizes, capacity)
    assert used <= 1.03 * -(-sum(sizes.values()) // capacity) + 2


def test_odd_tables(spark):
    kind = "doc_id bigint, n_tokens bigint, size int, container string"
    assert P.pack(spark.createDataFrame([], kind), 10).count() == 0
    got = P.pack(spark.createDataFrame([(1, None, 3, "x"), (2, 0, None, None), (3, 4, 1, "y")], kind), 10).orderBy("doc_id").collect()
    assert [(r.doc_id, r.size, r.container) for r in got] == [(1, 0, None), (2, 0, None), (3, 4, 0)]
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], kind), 0)


def test_same_containers_on_any_partitioning(spark):
    df = spark.createDataFrame([(i, i % 37 + 1) for i in range(400)], "doc_id bigint, n_tokens bigint")
    a = {tuple(r) for r in P.pack(df.repartition(1), 50).collect()}
    assert a == {tuple(r) for r in P.pack(df.repartition(9), 50).collect()}


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 60), st.data())
def test_plan_uses_every_item_once(capacity, data):
    hist = np.array([0, *data.draw(st.lists(st.integers(0, 30), min_size=capacity, max_size=capacity))])
    left = hist.copy()
    for held, many in P.plan(hist, capacity):
        assert sum(s * k for s, k in held.items()) <= capacity and many > 0
        for s, k in held.items():
            left[s] -= k * many
    assert not left.any()


def test_least_squares_fit_of_a_known_mix():
    capacity = 40
    pats = [((40, 1),), ((25, 1), (15, 1)), ((20, 2),), ((18, 1), (12, 1), (10, 1))]
    hist = np.zeros(capacity + 1)
    for (p, n) in zip(pats, (5, 7, 3, 9)):
        for s, k in p:
            hist[s] += k * n
    assert np.allclose(P.nnls(pats, hist, 2000), [5, 7, 3, 9], atol=0.05)


def test_fit_beats_best_fit():
    """Halves and quarters a little over and under: the longest first leaves room that no other fills."""
    hist, m = np.zeros(1001, dtype=int), 40
    hist[510], hist[270], hist[260], hist[230] = 6 * m, 6 * m, 6 * m, 12 * m
    used = lambda p: sum(n for _, n in p)
    assert used(P.best_fit(hist.astype(np.int64).copy(), 1000)) == 11 * m
    assert used(P.fit_patterns(hist, 1000)) <= 9.6 * m and P.plan(hist, 1000) == P.fit_patterns(hist, 1000)


def test_patterns_against_all_combinations():
    rng = np.random.default_rng(8)
    hist, capacity = (rng.random(49) < 0.4) * 3, 48
    hist[0] = 0
    sizes = np.flatnonzero(hist).tolist()
    want = {((s, capacity // s),) for s in sizes if capacity % s == 0}
    want |= {tuple(sorted({s: k, r: 1}.items(), reverse=True)) if s != r else ((s, k + 1),) for s in sizes for k in range(1, capacity // s + 1) if (r := capacity - s * k) in sizes and s * k >= capacity // 8}
    from collections import Counter
    from itertools import combinations_with_replacement

    want |= {tuple(sorted(Counter(x).items(), reverse=True)) for x in combinations_with_replacement(sizes, 3) if sum(x) == capacity and sum(v >= capacity // 8 for v in x) >= 2 and max(x) + min(x) <= capacity}
    got = set(P.patterns(hist, capacity))
    assert got <= want and {p for p in want if sum(k for _, k in p) == 3 and min(s for s, _ in p) >= capacity // 8} <= got


def test_large_capacities_are_planned(spark):
    capacity = 131_072
    rng = np.random.default_rng(6)
    hist = np.bincount(np.minimum(rng.lognormal(8.5, 1.6, 20_000).astype(int) + 1, capacity), minlength=capacity + 1)
    plan = P.plan(hist, capacity)
    least = -(-int((hist * np.arange(capacity + 1)).sum()) // capacity)
    assert least <= sum(n for _, n in plan) <= 1.02 * least + 2
