"""Boosted trees against a plain grower, isotonic fits against the max-min form."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetta.operators import features, isotonic, learn, pairstats, trees
from vetta.plans.lineage import checkpointed


def table(n, seed, gaps=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), rng.gauss(0, 1), float(rng.randint(0, 3))
        y = 3.0 * (a > 4) + b * (c > 1) + rng.gauss(0, .3)
        gap = gaps and rng.random() < .05
        rows.append((f"r{i}", i % 40, i % 3, None if gap and i % 2 else y, float(a), None if gap else b, c))
    return rows


SCHEMA = "row_id string, doc_id long, fold int, score double, a double, b double, c double"


def plain_tree(x, g, p, features):
    """One leaf after another: always the one with the largest gain."""
    def split(rows):
        best = None
        for f in features:
            for cut in range(int(x[:, f].max()) + 1):
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) < p.least_rows:
                    continue
                def part(r):
                    return max(abs(g[r].sum()) - p.l1, 0.0) ** 2 / (len(r) + p.l2)
                gain = part(left) + part(right) - part(rows)
                if gain > 0 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, cut, left, right
        return best

    leaves = [np.arange(len(x))]
    splits = {0: split(leaves[0])}
    while len(leaves) < p.leaves and any(splits.values()):
        i = max((k for k, s in splits.items() if s), key=lambda k: splits[k][0])
        _, _, _, left, right = splits[i]
        leaves[i] = left
        leaves.append(right)
        splits[i], splits[len(leaves) - 1] = split(left), split(right)
    value = np.zeros(len(x))
    for rows in leaves:
        s = g[rows].sum()
        value[rows] = -np.sign(s) * max(abs(s) - p.l1, 0.0) / (len(rows) + p.l2) * p.rate
    return value, len(leaves)


@pytest.mark.parametrize("leaves, least, l1, share, driver", [(31, 20, 0.1, 1.0, 1 << 25), (6, 5, 2.0, 1.0, 0), (12, 3, 0.0, 0.7, 1 << 25)])
def test_training_equals_a_plain_grower(spark, leaves, least, l1, share, driver, monkeypatch):
    monkeypatch.setattr(trees, "DRIVER_BYTES", driver)          # 0: sums added by Spark
    p = trees.Params(rounds=4, leaves=leaves, rate=0.3, least_rows=least, l1=l1, feature_share=share, row_share=1.0)
    rows = table(400, leaves)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    edges = [np.array([0., 2., 4., 5., 7.]), np.linspace(-2, 2, 9), np.array([0., 1., 2.])]
    base, models, _, start = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, None)], p, edges)
    base.unpersist()
    m = models[0]
    own = [r for r in rows if r[2] != 0 and r[3] is not None]
    x = np.array([[0 if v is None else 1 + int(np.searchsorted(e, v, "left")) for v, e in zip(r[4:], edges)] for r in own])
    y = np.array([r[3] for r in own])
    assert start[0] == pytest.approx(y.mean())
    pred = np.full(len(y), y.mean())
    for k in range(4):
        value, n = plain_tree(x, pred - y, p, trees.drawn_features(p, 3, 0, k))
        assert sum(f < 0 for f in m.trees[k].feature) == n
        assert m.trees[k].predict(x.astype(np.uint8)) == pytest.approx(value, abs=1e-9)
        pred = pred + value


def test_out_of_fold_predictions_and_stopping(spark):
    p = trees.Params(rounds=8, patience=3, rate=0.4, least_rows=5, leaves=8)
    rows = table(600, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    preds, importance = learn.gbt_oof(df, ["a", "b", "c"], k=3, params=p)
    got = {r["row_id"]: r for r in preds.collect()}
    assert len(got) == 600 and all(got[r[0]]["fold"] == r[2] for r in rows)
    known = [(r[3], got[r[0]]["gbt_score"]) for r in rows if r[3] is not None]
    gold, fit = map(np.array, zip(*known))
    assert np.abs(gold - fit).mean() < 0.5 * np.abs(gold - gold.mean()).mean()
    imp = {r["feature"]: r["importance"] for r in importance.collect()}
    assert set(imp) == {"a", "b", "c"} and imp["a"] > 0
    assert learn.top_features(importance, 2).count() == 2
    # gold of a fold changes nothing for its own rows
    changed = df.withColumn("score", F.when(F.col("fold") == 1, -F.col("score")).otherwise(F.col("score")))
    edges = trees.bin_edges(df, ["a", "b", "c"])
    folds = [(1, 2)]
    a, b = (trees.boost(t, ["a", "b", "c"], "score", "fold", folds, p, edges) for t in (df, changed))
    assert [t.value for t in a[1][0].trees] == [t.value for t in b[1][0].trees]


def test_models_share_passes_and_equal_models_alone(spark):
    p = trees.Params(rounds=4, patience=3, rate=0.4, least_rows=5, row_share=0.7, leaves=8)
    df = spark.createDataFrame(table(300, 8), SCHEMA).repartition(2)
    edges = trees.bin_edges(df, ["a", "b", "c"])
    both = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, 1), (1, 2)], p, edges)[1]
    alone = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, 1)], p, edges)[1]
    assert [(t.feature, t.cut) for t in both[0].trees] == [(t.feature, t.cut) for t in alone[0].trees]
    assert len(both[0].trees) == both[0].best_round


def test_folds_without_gold_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0, 1.0, 1.0, 1.0), ("b", 2, 1, None, 2.0, 2.0, 2.0)], SCHEMA)
    got = {r["row_id"]: r["gbt_score"] for r in learn.gbt_oof(df, ["a", "b", "c"], k=2)[0].collect()}
    assert got == {"a": None, "b": 1.0}
    assert learn.gbt_oof(df.where("false"), ["a"], k=2)[0].collect() == []


def test_lineage_is_cut(spark, monkeypatch):
    monkeypatch.setattr(trees, "CUT_EVERY", 2)
    p = trees.Params(rounds=5, rate=0.3, least_rows=5, leaves=4)
    df = spark.createDataFrame(table(200, 4), SCHEMA)
    edges = trees.bin_edges(df, ["a", "b", "c"])
    cut = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, 1)], p, edges)[1]
    monkeypatch.setattr(trees, "CUT_EVERY", 1000)
    kept = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, 1)], p, edges)[1]
    for a, b in itertools.zip_longest(cut[0].trees, kept[0].trees):
        assert a.value == pytest.approx(b.value)
    assert checkpointed(df).count() == 200


def test_passes_read_blocks_of_rows(spark):
    df = spark.createDataFrame(table(500, 3), SCHEMA).repartition(2)
    edges = trees.bin_edges(df, ["a", "b", "c"])
    rows = trees.binned(df, ["a", "b", "c"], edges, "score", "fold")
    blocks = trees.in_blocks(rows, np.array([1.5, -2.0]))
    assert blocks.count() == 2                          # an Arrow batch each, not 500 rows
    found = [b for part in blocks.toArrow().to_batches() for b in trees._blocks(part)]
    assert sum(len(y) for _, y, _, _, _ in found) == 500
    assert all((pred[0] == 1.5).all() and (pred[1] == -2.0).all() and x.shape == (3, len(y)) for _, y, _, x, pred in found)
    held = sorted((h, *x) for _, _, hs, xs, _ in found for h, x in zip(hs.tolist(), xs.T.tolist()))
    assert held == sorted((r["h"], *r["bins"]) for r in rows.collect())


def test_shares_of_a_table_give_the_same_trees(spark, monkeypatch):
    p = trees.Params(rounds=4, rate=0.4, least_rows=5, leaves=8, row_share=0.7)
    df = spark.createDataFrame(table(400, 7), SCHEMA).repartition(3)
    edges = trees.bin_edges(df, ["a", "b", "c"])
    whole = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, 1), (1, 2)], p, edges)[1]
    monkeypatch.setattr(trees, "SHARE_ROWS", 100)
    kept, sums = [], trees.sums

    def counted(rows, *more):
        kept.append(rows.count())
        return sums(rows, *more)
    monkeypatch.setattr(trees, "sums", counted)
    shared = trees.boost(df, ["a", "b", "c"], "score", "fold", [(0, 1), (1, 2)], p, edges)[1]
    assert kept[:4] != [kept[4]] * 4 and len(shared) == 2         # four shares of blocks, then all together
    for a, b in zip(whole, shared):
        assert [(t.feature, t.cut) for t in a.trees] == [(t.feature, t.cut) for t in b.trees]
        assert [v for t in a.trees for v in t.value] == pytest.approx([v for t in b.trees for v in t.value])


def test_kept_rows_are_small(spark):
    rows = [(f"row-{i:09d}", i % 500, i % 3, float(i % 40), float(i % 11), float(i % 7), float(i % 3)) for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    base = trees.binned_table(df, ["a", "b", "c"], trees.bin_edges(df, ["a", "b", "c"]), "score", "fold")
    assert base.inputFiles() and "h" in base.columns            # read from files, not from a lineage
    state = trees.in_blocks(base, np.zeros(1)).select(*[F.length(c) for c in ("fold", "y", "bins")]).collect()
    assert sum(map(sum, state)) < 20_000 * (4 + 8 + 3) / 3
    assert base.where(F.col("h") == F.xxhash64("row_id")).count() == 20_000


def test_features_move_no_derived_terms(spark):
    df = spark.createDataFrame(table(50, 2), SCHEMA).withColumn("tgt_lang", F.lit("de"))
    out, names = features.build_features(df, ["a", "b"])
    assert [c for c in out.columns if c.startswith("a_")] == [n for n in names if n.startswith("a_")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):]
    assert "a_minus_b" in plan and "a_minus_b" not in join and "is_de" not in join


# --- isotonic ---------------------------------------------------------------

def max_min(points):
    """Fit at each x by the max-min form: (x, value) in order of x."""
    xs = sorted({x for x, _ in points})
    w = [sum(1 for x, _ in points if x == v) for v in xs]
    s = [sum(y for x, y in points if x == v) for v in xs]
    def mean(j, k):
        return sum(s[j:k + 1]) / sum(w[j:k + 1])
    return xs, [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "long"])
def test_pools_merge_across_partitions(spark, shape, monkeypatch):
    monkeypatch.setattr(isotonic, "EACH", 8)            # several passes with several partitions
    rng = random.Random(3)
    groups = {}
    for g in range(4):
        n = [1, 40, 90, 7][g]
        for i in range(n):
            y = {"noise": rng.gauss(i / 30, 1), "falling": -i, "rising": i, "long": i if i < n - 1 else -1e6}[shape]
            groups.setdefault((f"lp{g % 2}", g), []).append((float(i), float(y)))
    rows = [(lp, f, x, x, 1.0, y) for (lp, f), pts in groups.items() for x, y in pts]
    df = spark.createDataFrame(rows, "lp string, f long, lo double, hi double, w double, s double").repartition(5)
    pooled, ends = isotonic.pools(df)
    table = isotonic.steps(pooled, ends)
    rng.shuffle(asked := [(f"{lp}{f}{x}{k}", lp, f, x) for (lp, f), pts in groups.items()
                          for x in [p[0] for p in pts] + [-5.0, 1000.0, 0.5, 3.25] for k in range(2)])
    asked += [("none", "other", 0, 1.0)]
    got = {r["row_id"]: r["fit"] for r in isotonic.looked_up(
        spark.createDataFrame(asked, "row_id string, lp string, f long, x double").repartition(3), table, "fit").collect()}
    assert got.pop("none") is None and len(got) == len(asked) - 1
    for (lp, f), pts in groups.items():
        xs, fit = max_min(pts)
        for row_id, a, b, x in asked:
            if (a, b) == (lp, f):
                assert got[row_id] == pytest.approx(np.interp(x, xs, fit), abs=1e-9)


def test_calibration_equals_max_min_out_of_fold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lp = rng.choice(["de", "de", "zh", "xx"])
        doc = rng.randint(0, 30) if lp != "xx" else 77
        x = rng.choice([None, *[v / 2 for v in range(20)]])
        rows.append((f"r{i}", doc if rng.random() > .05 else None, "en", lp, x, None if rng.random() < .1 else (x or 0) + rng.gauss(0, 3)))
    df = spark.createDataFrame(rows, "row_id string, doc_id long, src_lang string, tgt_lang string, p double, score double").repartition(4)
    got = {r["row_id"]: r for r in learn.isotonic_oof(df, "p", k=4).collect()}
    assert len(got) == len(rows)
    sizes = pd.DataFrame([(r[3], r[1]) for r in rows if r[1] is not None], columns=["lp", "doc"]).value_counts().reset_index()
    for lp, own in sizes.groupby("lp"):
        order = own.sort_values(["count", "doc"], ascending=[False, True])["doc"].tolist()
        kk = min(4, len(order))
        fold = {d: (i % kk if i // kk % 2 == 0 else kk - 1 - i % kk) if kk > 1 else -1 for i, d in enumerate(order)}
        for r in rows:
            if r[3] != lp:
                continue
            f = fold.get(r[1], 0 if kk > 1 else -1)
            assert got[r[0]]["fold"] == f
            train = [(q[4], q[5]) for q in rows if q[3] == lp and fold.get(q[1], 0) != f and q[4] is not None and q[5] is not None]
            if r[4] is None:
                assert got[r[0]]["calibrated"] is None
            elif kk < 2 or not train:
                assert got[r[0]]["calibrated"] == r[4]
            else:
                assert got[r[0]]["calibrated"] == pytest.approx(np.interp(r[4], *max_min(train)), abs=1e-9)


@pytest.mark.parametrize("small", [64, 4])
def test_moments_of_all_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(pairstats, "SMALL_GROUP", small)
    rng = random.Random(8)
    rows = [(rng.randint(0, 12), rng.choice([None, *range(0, 9)]), rng.gauss(0, 1), rng.choice([None, float("nan"), 1.0, 2.5, -1.0]))
            for _ in range(150)]
    rows = [(a, None if b is None else b / 2, c, d) for a, b, c, d in rows]
    df = spark.createDataFrame(rows, "doc_id long, score double, u double, v double").repartition(3)
    n, v, g = learn.pair_moments(df, ["u", "v"])
    whole = [r for r in rows if r[1] is not None and r[3] is not None and r[3] == r[3]]
    d = np.array([np.subtract(p[2:], q[2:]) for p in whole for q in whole if p[0] == q[0] and p[1] - q[1] > 1.0])
    assert n == len(d) > 50
    assert v == pytest.approx(d.sum(axis=0)) and g == pytest.approx(d.T @ d)
    # at the weights the gradient of the squared loss over all pairs is nought
    scored, weights = learn.all_pairs_ranker(df, ["u", "v"], alpha=0.5)
    w = np.array([r["weight"] for r in weights.collect()])
    assert d.T @ (d @ w - 1) + 0.5 * w == pytest.approx(np.zeros(2), abs=1e-8)
    assert scored.columns == [*df.columns, "ranker_score"] and scored.count() == 150
    assert learn.pair_moments(df.where("false"), ["u", "v"])[0] == 0
