"""Kernels of sources above the array limit, against loops over all pairs."""

import itertools

import numpy as np
import pytest

from vetta.operators import learn, pairs, pairstats as ps


def _rows(seed=5, n=90):
    rng = np.random.default_rng(seed)
    rows = [(f"b{i}", 1, float(rng.integers(0, 900)) / 100, float(np.round(rng.normal(), 2)), float(rng.integers(0, 5))) for i in range(n)]
    return rows + [(f"s{i}", 2 + i // 4, float(rng.integers(0, 9)), float(rng.integers(0, 3)), 1.0) for i in range(10)]


def _pairs(rows, gap):
    for a, b in itertools.permutations(rows, 2):
        if a[1] == b[1] and a[2] - b[2] > gap:
            yield a, b


def _no_dominance(monkeypatch):
    def called(*a, **k):
        raise AssertionError("a source below the bound goes through dominance counts")
    monkeypatch.setattr(ps, "dominance", called)


def test_partners_and_prefixes():
    rng = np.random.default_rng(2)
    v = np.sort(np.concatenate((rng.integers(0, 40, 70) / 10, [-np.inf, np.inf, np.inf])))
    for strict in (True, False):
        with np.errstate(invalid="ignore"):
            far = v[:, None] - v[None, :] > .3 if strict else v[:, None] - v[None, :] >= .3
        assert (ps.partners(v, v, .3, strict) == far.sum(axis=1)).all()
    b, k, x = rng.integers(0, 9, 37).astype(float), rng.integers(0, 38, 37), rng.integers(-1, 10, 37).astype(float)
    for strict, (count, total) in zip((True, False), ps.above(b, [(k, x, True), (k, x, False)])):
        hit = [[c for c in b[:j] if (c > y if strict else c >= y)] for j, y in zip(k, x)]
        assert count.tolist() == [len(h) for h in hit] and total == pytest.approx([sum(h) for h in hit])


def test_pair_moments_of_a_large_source_take_one_kernel_call(spark, monkeypatch):
    """17 products of each row were counted by dominance."""
    rows = _rows()
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, u double, v double")
    d = np.array([[a[3] - b[3], a[4] - b[4]] for a, b in _pairs(rows, 1.0)])

    def check():
        n, v, g = learn.pair_moments(df, ["u", "v"])
        assert n == len(d) and v == pytest.approx(d.sum(axis=0)) and g == pytest.approx(d.T @ d)

    with monkeypatch.context() as m:
        _no_dominance(m)
        check()


@pytest.mark.parametrize("margin,gap,adaptive", [(.01, 1.0, True), (.001, 1.0, True), (.01, .5, False)])
def test_pair_sums_of_a_large_source_take_one_kernel_call(spark, monkeypatch, margin, gap, adaptive):
    """ten dominance counts over the same rows."""
    rows = _rows(6)
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, u double, v double")
    n = h = q = r = 0.0
    for a, b in _pairs(rows, gap):
        m = max(.5 * (a[2] - b[2]) / 100, margin) if adaptive else margin
        n, h, r = n + 1, h + max(0.0, m - (a[3] - b[3])), r + (a[3] > b[3])
        q += ((a[3] - a[2] / 100) ** 2 + (b[3] - b[2] / 100) ** 2) / 2

    def check():
        got = pairs.pair_sums(df, "u", margin=margin, gap=gap, adaptive=adaptive).first()
        assert (got.n_pairs, got.right) == (n, r) and (got.hinge, got.squares) == pytest.approx((h, q))

    with monkeypatch.context() as m:
        _no_dominance(m)
        check()


def test_preference_counts_in_bounded_partitions(spark, monkeypatch):
    """small sources went through points and a join, in as many
    partitions at any size."""
    rows = _rows(7)
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, u double, v double")
    expected = {r[1]: 0 for r in rows}
    for a, _ in _pairs(rows, 1.0):
        expected[a[1]] += 1

    def check():
        assert {r.doc_id: r.n_pairs for r in pairs.preference_counts(df).collect()} == expected

    with monkeypatch.context() as m:
        _no_dominance(m)
        m.setattr(pairs, "PART_ROWS", 4)
        check()
        plan = pairs.preference_counts(df)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(doc_id#" in plan and ", 25)" in plan
        assert "SortMergeJoin" not in plan
    monkeypatch.setattr(ps, "BLOCK_POINTS", 80)
    check()


@pytest.mark.parametrize("values", [3, 40, 3000])
def test_self_counts_by_histograms(monkeypatch, values):
    """blocks of many positions are compared by histograms, also in slabs."""
    rng = np.random.default_rng(values)
    a, b, w = rng.integers(0, 500, 900).astype(float), rng.integers(0, values, 900).astype(float), rng.integers(1, 4, 900).astype(float)
    less = (a[:, None] < a[None, :]) * (w[:, None] * w[None, :])
    expected = less.sum(), (less * (b[:, None] < b[None, :])).sum(), (less * (b[:, None] > b[None, :])).sum()
    assert ps._self_counts(a, b, w) == expected
    monkeypatch.setattr(ps, "HISTOGRAM", 64)
    assert ps._self_counts(a, b, w) == expected


def test_few_gold_values_need_one_cut(spark, monkeypatch):
    """with few values of b only a is cut into blocks (three dominance
    counts of blocks before), and edges are searched, not scanned."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 300, 400).astype(float), rng.integers(0, 6, 400).astype(float)
    df = spark.createDataFrame([(1, x, y, 1.0, 2) for x, y in zip(a.tolist(), b.tolist())], "k int, a double, b double, w double, t int")
    calls, dominance = [], ps.dominance
    monkeypatch.setattr(ps, "dominance", lambda pts, keys, *x: calls.append(list(keys)) or dominance(pts, keys, *x))
    got = ps.dominance(df, ["k"], True, 120).first()
    less = a[:, None] < a[None, :]
    assert (got.lt, got.gt) == ((less & (b[:, None] < b[None, :])).sum(), (less & (b[:, None] > b[None, :])).sum())
    assert not any(any(c.startswith("_bb") for c in keys) for keys in calls)
