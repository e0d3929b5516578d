"""Line search over tau breakpoints and the climb built on it."""

import functools
import itertools
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetta.operators import blend, pairstats, sourceruns, weights

SIGNALS = ["a", "b", "c", "d", "e", "f"]


def blended(x, w):
    out = x[0] * w[0]
    for u, v in zip(x[1:], w[1:]):
        out += u * v
    return out / sum(w)


def mean_tau(rows, w):
    """Mean per-source tau-b of the blend, by all pairs."""
    taus = []
    for doc, own in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        own = list(own)
        if any(v is None or v != v for r in own for v in r[1:]) and len(own) > 1:
            continue
        s = tx = ty = n = 0
        for p, q in itertools.combinations(own, 2):
            g = np.sign(p[1] - q[1])
            x = np.sign(blended(p[2:], w) - blended(q[2:], w))
            s, tx, ty, n = s + x * g, tx + (x == 0), ty + (g == 0), n + 1
        if (n - tx) * (n - ty) > 0:
            taus.append(s / np.sqrt((n - tx) * (n - ty)))
    return float(np.mean(taus)) if taus else 0.0


def ratings(n_docs, k, seed, big=0):
    rng = random.Random(seed)
    rows = []
    for doc in range(n_docs):
        for _ in range(big if doc == 0 and big else rng.randint(1, 7)):
            x = [rng.randint(0, 12) / 4 for _ in range(k)]
            rows.append((doc, float(round(sum((i + 1) * v for i, v in enumerate(x)) + rng.gauss(0, 4))), *x))
    return rows


def frame(spark, rows, k):
    return spark.createDataFrame(rows, "doc_id long, score double, " + ", ".join(f"{s} double" for s in SIGNALS[:k])).repartition(5)


@pytest.mark.parametrize("seed, base", [(1, (1.0, 1.0, 1.0)), (2, (0.3, 0.0, 0.9)), (3, (0.0, 0.0, 1.0))])
def test_line_is_exact(spark, seed, base, monkeypatch):
    monkeypatch.setattr(weights, "BINS", 5)             # several refinements
    rows = ratings(40, 3, seed)
    got = {r["signal"]: r for r in weights.line_optima(frame(spark, rows, 3), SIGNALS[:3], base).collect()}
    for j, s in enumerate(SIGNALS[:3]):
        if sum(base) == base[j]:
            assert s not in got
            continue
        cuts = {0.0, 1.0}
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            for p, q in itertools.combinations(list(own), 2):
                d0 = sum(base[i] * (p[2 + i] - q[2 + i]) for i in range(3) if i != j)
                d1 = p[2 + j] - q[2 + j]
                if d1 and 0 < -d0 / d1 < 1:
                    cuts.add(round(-d0 / d1, 9))
        cuts = sorted(cuts)
        value = [mean_tau(rows, [(u + v) / 2 if i == j else x for i, x in enumerate(base)]) for u, v in zip(cuts[:-1], cuts[1:])]
        assert got[s]["tau"] == pytest.approx(max(value), abs=1e-9)
        i = next(i for i, v in enumerate(value) if v >= max(value) - 1e-9)
        assert (got[s]["low"], got[s]["high"]) == pytest.approx((cuts[i], cuts[i + 1]))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_search_beats_the_grid_and_is_a_true_tau(spark, k):
    rows = ratings(60, k, 7)
    df = frame(spark, rows, k)
    got = weights.search(df, SIGNALS[:k]).collect()
    w = [r["weight"] for r in got]
    assert all(0 <= x <= 1 for x in w) and [r["signal"] for r in got] == SIGNALS[:k]
    assert got[0]["tau"] == pytest.approx(mean_tau(rows, w), abs=1e-9)
    assert got[0]["tau"] >= max(r["tau"] for r in blend.weight_sweep(df, SIGNALS[:k]).collect()) - 1e-9


def test_many_signals_need_no_grid(spark, monkeypatch):
    rows = ratings(30, 6, 9)
    monkeypatch.setattr(blend, "candidate_grid", None)          # 5^6 candidates otherwise
    got = weights.search(frame(spark, rows, 6), SIGNALS).collect()
    w = [r["weight"] for r in got]
    assert got[0]["tau"] == pytest.approx(mean_tau(rows, w), abs=1e-9)
    assert got[0]["tau"] >= max(mean_tau(rows, v) for v in ([1] * 6, *np.eye(6))) - 1e-9
    # no move along one weight gains
    optima = weights.line_optima(frame(spark, rows, 6), SIGNALS, w).collect()
    assert max(r["tau"] for r in optima) <= got[0]["tau"] + 1e-8


def test_large_sources_count_in_the_objective(spark):
    rows = ratings(20, 2, 4, big=pairstats.SMALL_GROUP + 30)
    got = weights.search(frame(spark, rows, 2), SIGNALS[:2]).collect()
    assert got[0]["tau"] == pytest.approx(mean_tau(rows, [r["weight"] for r in got]), abs=1e-9)
    assert got[0]["tau"] >= max(mean_tau(rows, v) for v in blend.candidate_grid(2)) - 1e-9


def test_gaps_ties_and_empty_tables(spark):
    rows = ratings(12, 2, 3) + [(100, None, 1.0, 2.0), (100, 2.0, 1.0, 1.0), (101, 1.0, None, 1.0), (101, 2.0, 1.0, 0.0),
                                (102, 1.0, 1.0, 1.0), (102, 1.0, 2.0, 3.0), (103, 1.0, 1.0, 1.0), (103, 2.0, 1.0, 1.0)]
    df = frame(spark, rows, 2)
    got = weights.search(df, SIGNALS[:2]).collect()
    assert got[0]["tau"] == pytest.approx(mean_tau(rows, [r["weight"] for r in got]), abs=1e-9)
    nothing = weights.search(df.where("false"), SIGNALS[:2]).collect()
    assert [r["tau"] for r in nothing] == [0.0, 0.0]


def test_cross_validated_weights_never_see_their_fold(spark):
    rows = ratings(50, 2, 12)
    df = frame(spark, rows, 2)
    fold = {r["doc_id"]: r["fold"] for r in blend.doc_folds(df, k=3).collect()}
    got = weights.cross_validated(df, SIGNALS[:2], k=3).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2]
    for r in got:
        w = [r["w_a"], r["w_b"]]
        own = [x for x in rows if fold[x[0]] == r["fold"]]
        rest = [x for x in rows if fold[x[0]] != r["fold"]]
        assert r["val_tau"] == pytest.approx(mean_tau(own, w), abs=1e-9)
        assert r["train_tau"] == pytest.approx(mean_tau(rest, w), abs=1e-9)
        assert r["train_tau"] >= max(mean_tau(rest, v) for v in blend.candidate_grid(2)) - 1e-9


def test_runs_stream_whole_sources_in_bounded_steps(monkeypatch):
    monkeypatch.setattr(sourceruns, "RUN_PAIRS", 50)
    rng = random.Random(1)
    rows = pd.DataFrame(sorted((rng.randint(0, 40), rng.random(), rng.random()) for _ in range(300)), columns=["doc_id", "_y", "a"])
    batches = [rows.iloc[i:i + 7] for i in range(0, len(rows), 7)]
    found = []
    for r in sourceruns.runs(iter(batches), ["a"]):
        assert len(r.left) <= 50 or len(r.n_pairs) == 1
        assert (r.source == np.repeat(np.arange(len(r.n_pairs)), r.n_pairs)).all()
        found += [tuple(sorted(p)) for p in zip(r.y[r.left], r.y[r.right])]
    want = [tuple(sorted(p)) for _, own in rows.groupby("doc_id") for p in itertools.combinations(own["_y"], 2)]
    assert sorted(found) == sorted(want)


def test_packed_runs_are_the_runs_that_have_a_tau(spark):
    rows = [r for r in ratings(30, 2, 5)] + [(100, None, 1.0, 2.0), (100, 2.0, 1.0, 1.0), (101, 1.0, None, 1.0), (101, 2.0, 1.0, 0.0),
                                             (102, 1.0, 1.0, 1.0), (102, 1.0, 2.0, 3.0), (103, 1.0, float("inf"), 1.0),
                                             (103, 2.0, float("inf"), 2.0), (104, float("inf"), 1.0, 1.0), (104, float("inf"), 2.0, 3.0),
                                             (104, 1.0, 2.0, 3.0)]
    df = frame(spark, rows, 2)
    plain, packed = blend.Sources(df, SIGNALS[:2]), blend.Sources(df, SIGNALS[:2]).persist()
    assert packed.small.columns == ["x", "y", "fold", "size"] and packed.small.count() < len(rows)
    cands = blend.candidate_grid(2)
    plain, kept = ({r["cand"]: (r["sum_tau"], r["n_def"]) for r in s.tau_sums(cands).collect()} for s in (plain, packed))
    packed.unpersist()
    assert {c: n for c, (_, n) in plain.items()} == {c: n for c, (_, n) in kept.items()}
    assert [kept[c][0] for c in sorted(kept)] == pytest.approx([plain[c][0] for c in sorted(kept)], abs=1e-9)


def test_equal_candidates_are_scored_once(spark, monkeypatch):
    asked = []
    sums = blend.Sources.tau_sums

    def counted(self, candidates):
        asked.append(list(candidates))
        return sums(self, candidates)
    monkeypatch.setattr(blend.Sources, "tau_sums", counted)
    weights.cross_validated(frame(spark, ratings(30, 2, 6), 2), SIGNALS[:2], k=3)
    assert all(len(c) == len(set(c)) for c in asked[:-1])


def test_a_line_takes_few_passes(monkeypatch):
    """Each pass reads all pairs: few of them find the optimum that many find."""
    rng = np.random.default_rng(11)
    x = rng.random((14_000, 3))
    rows = pd.DataFrame({"doc_id": np.repeat(np.arange(2000), 7), "_y": x.sum(axis=1) + rng.normal(size=len(x)),
                         **{s: c for s, c in zip(SIGNALS, x.T)}})
    passes = []

    def profile(sources, tracks, edges):
        passes.append(1)
        read = functools.partial(sourceruns.runs, signals=SIGNALS[:3])
        return pd.concat(weights._bin_sums(read, tracks, edges)(iter([rows])))

    monkeypatch.setattr(weights, "bin_profile", profile)
    few = weights.exact_lines(SimpleNamespace(signals=SIGNALS[:3]), [((1.0, 1.0, 1.0), None)])
    assert len(passes) <= 3
    monkeypatch.setattr(weights, "BINS", 16)
    many = weights.exact_lines(SimpleNamespace(signals=SIGNALS[:3]), [((1.0, 1.0, 1.0), None)])
    assert len(passes) > 6
    for at in few:
        assert few[at].best() == pytest.approx(many[at].best(), abs=1e-9)


def test_bins_of_a_pass_are_bounded():
    assert weights._bins(3) == weights.BINS
    assert all(weights._bins(n) * n <= max(weights.PASS_BINS, weights.LEAST_BINS * n) for n in (1, 3, 100, 10_000))


def best_on_line(rows, base, j):
    """(tau, low, high) of the first best interval along weight ``j``, by all pairs."""
    k, cuts = len(base), {0.0, 1.0}
    for _, own in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        for p, q in itertools.combinations(list(own), 2):
            d0 = sum(base[i] * (p[2 + i] - q[2 + i]) for i in range(k) if i != j)
            d1 = p[2 + j] - q[2 + j]
            if d1 and 0 < -d0 / d1 < 1:
                cuts.add(round(-d0 / d1, 9))
    cuts = sorted(cuts)
    value = [mean_tau(rows, [(u + v) / 2 if i == j else x for i, x in enumerate(base)]) for u, v in zip(cuts[:-1], cuts[1:])]
    i = next(i for i, v in enumerate(value) if v >= max(value) - 1e-9)
    return value[i], cuts[i], cuts[i + 1]


@pytest.fixture
def few_rows_whole(monkeypatch):
    """Sources of more than four rows are large ones, of several blocks and steps."""
    monkeypatch.setattr(sourceruns, "WHOLE", 4)
    monkeypatch.setattr(sourceruns, "BLOCK", 3)
    monkeypatch.setattr(sourceruns, "RUN_PAIRS", 7)


@pytest.mark.parametrize("seed, base", [(5, (1.0, 1.0)), (6, (0.0, 0.5)), (7, (0.25, 0.0, 0.75))])
def test_lines_count_the_pairs_of_large_sources(spark, seed, base, few_rows_whole):
    k = len(base)
    rows = ratings(14, k, seed, big=18)
    rows += rows[3:9] + [(200, None if i == 2 else 1.0 * i, *[float(i)] * k) for i in range(6)]      # rows that come twice, a gap
    got = {r["signal"]: r for r in weights.line_optima(frame(spark, rows, k), SIGNALS[:k], base).collect()}
    want = {s: best_on_line(rows, base, j) for j, s in enumerate(SIGNALS[:k]) if sum(base) > base[j]}
    assert set(got) == set(want)
    for s, (tau, low, high) in want.items():
        assert got[s]["tau"] == pytest.approx(tau, abs=1e-9)
        assert (got[s]["low"], got[s]["high"]) == pytest.approx((low, high))


def test_a_source_is_counted_at_any_size(spark):
    """One source of more rows than the pair statistics take as small."""
    rows = ratings(6, 2, 8, big=pairstats.SMALL_GROUP + 6)
    got = {r["signal"]: r for r in weights.line_optima(frame(spark, rows, 2), SIGNALS[:2]).collect()}
    for j, s in enumerate(SIGNALS[:2]):
        assert (got[s]["tau"], got[s]["low"], got[s]["high"]) == pytest.approx(best_on_line(rows, (1.0, 1.0), j), abs=1e-9)


def test_blocks_give_the_bins_of_whole_sources(spark, monkeypatch):
    rows = ratings(12, 3, 21, big=30) + [(300, 1.0, 1.0, 1.0, 1.0)] * 9
    df = frame(spark, [(d % 3, *r) for d, *r in rows], 3).withColumn("f", F.col("doc_id") % 2)
    tracks = [((1.0, 0.3, 0.7), None), ((0.2, 1.0, 0.0), 1)]
    edges = [[np.linspace(0, 1, 8)[:-1]] * 3, [np.linspace(0, 1, 5)[:-1], None, np.array([0.0, 0.5])]]
    found = []
    for whole, block in ((sourceruns.WHOLE, sourceruns.BLOCK), (4, 4096), (4, 5)):
        monkeypatch.setattr(sourceruns, "BLOCK", block)
        sources = blend.Sources(df, SIGNALS[:3], "score", "f", whole).persist()
        assert bool(sources.n_big) == (whole == 4)
        found.append(weights.bin_profile(sources, tracks, edges).sort_values(["track", "line", "bin"]).reset_index(drop=True))
        sources.unpersist()
    for other in found[1:]:
        pd.testing.assert_frame_equal(found[0], other, rtol=1e-9, atol=1e-12)


def test_search_ends_where_no_weight_gains_with_large_sources(spark, few_rows_whole):
    """All rows are in two large sources."""
    rows = [(r[0] % 2, *r[1:]) for r in ratings(14, 3, 17)]
    df = frame(spark, rows, 3)
    got = weights.search(df, SIGNALS[:3]).collect()
    w, tau = [r["weight"] for r in got], got[0]["tau"]
    assert tau == pytest.approx(mean_tau(rows, w), abs=1e-9)
    assert tau > max(mean_tau(rows, v) for v in weights._starts(3)) + 1e-6
    assert all(best_on_line(rows, w, j)[0] <= tau + 1e-8 for j in range(3))


def test_folds_climb_over_large_sources(spark, few_rows_whole):
    rows = [(r[0] % 4, *r[1:]) for r in ratings(18, 3, 17)]
    df = frame(spark, rows, 3)
    fold = {r["doc_id"]: r["fold"] for r in blend.doc_folds(df, k=2).collect()}
    for r in weights.cross_validated(df, SIGNALS[:3], k=2).collect():
        w, rest = [r[f"w_{s}"] for s in SIGNALS[:3]], [x for x in rows if fold[x[0]] != r["fold"]]
        assert r["train_tau"] == pytest.approx(mean_tau(rest, w), abs=1e-9)
        assert all(best_on_line(rest, w, j)[0] <= r["train_tau"] + 1e-8 for j in range(3) if sum(w) > w[j])


def test_a_climb_goes_on_until_no_weight_gains(spark, monkeypatch):
    """More moves than any bound: a line that gains a little each time."""
    taus = iter(np.linspace(0.0, 0.5, 51))
    last = [0.0]

    def objective(sources, candidates, held):
        last[0] = next(taus, last[0])
        return np.full(len(candidates), last[0])

    line = SimpleNamespace(best=lambda: (1.0, 0.0, 1.0))
    monkeypatch.setattr(weights, "_objective", objective)
    monkeypatch.setattr(weights, "exact_lines", lambda sources, tracks, wanted: {at: line for at in wanted})
    (_, tau), = weights._climb(SimpleNamespace(signals=SIGNALS[:2], n_big=0), [None])
    assert tau == pytest.approx(0.5)
