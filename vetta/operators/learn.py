"""Learning over folds: boosted trees, isotonic calibration, ridge
stacking and a pairwise ranker, all out-of-fold by source.

Trees and isotonic fits take all folds in the same passes (``trees``,
``isotonic``), ridge is one aggregation, the ranker a Spark ML job; the driver
picks splits and solves k x k systems.  Folds are dealt by
source size (``balanced_folds``), so each fold has a source where there are as
many sources as folds; rows without gold do not train but are predicted, and
where nothing can be fitted a row keeps its raw score: no row is lost."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.operators import isotonic, pairstats, sourceruns, trees
from vetta.operators.blend import N_FOLDS, SEED, Sources, balanced_folds
from vetta.operators.pairs import MIN_GAP
from vetta.operators.rank import nan_to_null
from vetta.plans.lineage import releasing
from vetta.plans.ordered import positions_in_group

RIDGE_ALPHA = 1.0


def with_folds(df: DataFrame, k: int, fold_col: str = "fold", key: str = "doc_id") -> DataFrame:
    """``df`` with the size-balanced fold of each source; rows without a source
    are fold 0 (they share none with other rows)."""
    folds = balanced_folds(df.filter(F.col(key).isNotNull()), key, k).select(key, F.col("fold").alias(fold_col))
    return df.join(folds, key, "left").withColumn(fold_col, F.coalesce(fold_col, F.lit(0).cast("long")))


def gbt_oof(df: DataFrame, features, gold: str = "score", k: int = N_FOLDS, fold_col: str = "fold",
            out: str = "gbt_score", params: trees.Params = trees.Params(), edges=None):
    """Out-of-fold boosted-tree predictions.  Early stopping watches an inner
    split of the training sources (the next fold), never the held-out fold; with
    one other fold the models watch their own training error.  Returns
    ``(predictions, importances)``; a fold whose training rows have no gold is
    predicted as null."""
    with releasing(df.sparkSession):
        base = df if fold_col in df.columns else with_folds(df, k, fold_col)
    base = base.withColumn(gold, nan_to_null(gold))

    def folds(gold_folds: set) -> list[tuple[int, int | None]]:
        found = []
        for f in range(k):
            others = sorted(gold_folds - {f})
            if others:
                # the inner split needs training rows beside it
                inner = next((g for g in ((f + s) % k for s in range(1, k)) if g in others), None) if len(others) > 1 else None
                found.append((f, inner))
        return found

    rows, models, _, start = trees.boost(base, features, gold, fold_col, folds, params, edges)
    preds = trees.held_out(rows, models, start, out).withColumn("row_id", F.col("row_id").cast(df.schema["row_id"].dataType))
    imp_df = df.sparkSession.createDataFrame(trees.importances(models, list(features)), "feature string, importance double")
    return preds, imp_df


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def lp_folds(df: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(_lp, key, fold): in each language pair its sources by size (largest first,
    ties by id), dealt in a snake over as many folds as it has sources, ``k`` at
    most; -1 where it has one source."""
    sizes = df.where(F.col(key).isNotNull()).groupBy("_lp", key).agg((-F.count(F.lit(1))).alias("_neg"))
    p = positions_in_group(sizes, ["_lp"], "_neg", [key])
    kk = F.least(F.col("_gn"), F.lit(k))
    at, rnd = F.pmod(F.col("_gpos"), kk), F.floor(F.col("_gpos") / kk)
    fold = F.when(F.col("_gn") < 2, -1).when(rnd % 2 == 0, at).otherwise(kk - 1 - at)
    return p.select("_lp", key, fold.cast("long").alias("fold"), F.col("_gn").alias("_n_docs"))


def isotonic_oof(df: DataFrame, pred: str, gold: str = "score", k: int = N_FOLDS, out: str = "calibrated") -> DataFrame:
    """Isotonic calibration per language pair, out of fold by source.  Folds
    are dealt by source size inside each language pair, so a pair of two
    sources has two folds; where the training side of a fold has no gold the
    row keeps its raw prediction (fold -1 where the pair has one source).
    Predictions outside the fitted range are clipped to the end values.  All
    language pairs and folds are fitted together."""
    base = df.withColumn("_lp", F.concat_ws("->", "src_lang", "tgt_lang")) \
        .withColumn(pred, nan_to_null(pred)).withColumn(gold, nan_to_null(gold))
    folds = lp_folds(base, k)
    docs = folds.groupBy("_lp").agg(F.max("_n_docs").alias("_n"))
    # rows without a source are in fold 0; in a pair of at most one source all rows are in fold -1
    rows = base.join(folds.drop("_n_docs"), ["_lp", "doc_id"], "left").join(docs, "_lp", "left")
    fold = F.when(F.coalesce("_n", F.lit(0)) < 2, -1).otherwise(F.coalesce("fold", F.lit(0))).cast("long")
    rows = rows.select("row_id", F.col("_lp").alias("lp"), fold.alias("f"), F.col(pred).alias("x"), F.col(gold).alias("y"), "_n")
    # one pass for the points and for the values that are looked up
    values = rows.where(F.col("x").isNotNull()).groupBy("lp", "f", "x", "_n") \
        .agg(F.count("y").cast("double").alias("w"), F.sum("y").alias("s")).persist()
    n_values = values.count()
    points = values.where((F.col("f") >= 0) & (F.col("w") > 0))
    held = F.explode(F.array_remove(F.sequence(F.lit(0).cast("long"), F.least("_n", F.lit(k)) - 1), F.col("f")))
    points = points.withColumn("f", held).groupBy("lp", "f", "x").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    pooled, ends = isotonic.pools(points.select("lp", "f", F.col("x").alias("lo"), F.col("x").alias("hi"), "w", "s"))
    steps = isotonic.steps(pooled, ends)
    if n_values <= pairstats.BROADCAST_KEYS:
        # few values: each is looked up once and goes to its rows, which are not sorted
        asked = values.select(F.lit("").alias("row_id"), "lp", "f", "x")
        fits = isotonic.looked_up(asked, steps, "_fit").select("lp", "f", "x", "_fit")
        return rows.join(F.broadcast(fits), ["lp", "f", "x"], "left") \
            .select("row_id", F.col("f").alias("fold"), F.coalesce("_fit", "x").alias(out))
    values.unpersist()
    fitted = isotonic.looked_up(rows, steps, "_fit")
    pooled.unpersist()
    found = fitted.select("row_id", F.col("f").alias("fold"), F.coalesce("_fit", "x").alias(out))
    return found.unionByName(rows.where(F.col("x").isNull()).select("row_id", F.col("f").alias("fold"), F.col("x").alias(out)))


def ridge_oof(df: DataFrame, features, gold: str = "score", alpha: float = RIDGE_ALPHA,
              k: int = N_FOLDS, seed: int = SEED, out: str = "meta_score"):
    """Ridge stacking out of fold, intercept unpenalised.  One aggregation
    gives per-fold sums of x, y, xx' and xy over the rows that have gold and
    every feature; a fold's training statistics are the totals minus the fold;
    each k x k system is solved on the driver.  Every row is returned: a row
    that lacks a feature has no prediction, a fold without training rows keeps
    the mean of the features.  Returns ``(predictions, coefficients)``."""
    feats = list(features)
    m = len(feats)
    base = with_folds(df, k).select("row_id", "fold", nan_to_null(gold).alias("_y"),
                                    *[nan_to_null(c).alias(f"_f{i}") for i, c in enumerate(feats)])
    x = [F.col(f"_f{i}") for i in range(m)]
    y = F.col("_y")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy")]
    aggs += [F.sum(x[i]).alias(f"sx{i}") for i in range(m)]
    aggs += [F.sum(x[i] * y).alias(f"sxy{i}") for i in range(m)]
    aggs += [F.sum(x[i] * x[j]).alias(f"sxx{i}_{j}") for i in range(m) for j in range(i, m)]
    sums = {r["fold"]: r for r in base.dropna().groupBy("fold").agg(*aggs).collect()}   # one row per fold
    coefs = []
    for f in range(k):
        rows = [r for g, r in sums.items() if g != f]
        n = sum(r["n"] for r in rows)
        if not n:
            coefs.append((f, 0.0, *[1.0 / m] * m))
            continue
        mx = np.array([sum(r[f"sx{i}"] for r in rows) for i in range(m)]) / n
        my = sum(r["sy"] for r in rows) / n
        cxy = np.array([sum(r[f"sxy{i}"] for r in rows) for i in range(m)]) - n * mx * my
        cxx = np.array([[sum(r[f"sxx{min(i, j)}_{max(i, j)}"] for r in rows) for j in range(m)]
                        for i in range(m)]) - n * np.outer(mx, mx)
        beta = np.linalg.solve(cxx + alpha * np.eye(m), cxy)
        coefs.append((f, float(my - mx @ beta), *map(float, beta)))
    cdf = df.sparkSession.createDataFrame(
        coefs, "fold long, intercept double, " + ", ".join(f"b{i} double" for i in range(m)))
    pred = F.col("intercept")
    for i in range(m):
        pred = pred + F.col(f"b{i}") * x[i]
    res = base.join(F.broadcast(cdf), "fold").select("row_id", "fold", pred.alias(out))     # k rows
    return res, cdf


def _pair_terms(m: int) -> list[tuple[tuple, int, tuple, tuple]]:
    """(sum it belongs to, sign, factors of the better row, factors of the worse
    row): the sums over pairs of 1, d and d d' with d = better - worse, as products
    of one row's features each."""
    out = [((), 1, (), ())]
    for i in range(m):
        out += [((i,), 1, (i,), ()), ((i,), -1, (), (i,))]
        for j in range(i, m):
            out += [((i, j), 1, (i, j), ()), ((i, j), -1, (i,), (j,)), ((i, j), -1, (j,), (i,)), ((i, j), 1, (), (i, j))]
    return out


def _small_moments(features, gap: float):
    m = len(features)
    cells = _moment_cells(m)

    def run(batches):
        n, v, g = 0.0, np.zeros(m), np.zeros((m, m))
        for r in sourceruns.runs(batches, features):
            diff = r.y[r.left] - r.y[r.right]
            use = np.abs(diff) > gap
            d = (r.x[r.left[use]] - r.x[r.right[use]]) * np.sign(diff[use])[:, None]
            n, v, g = n + len(d), v + d.sum(axis=0), g + d.T @ d
        yield pd.DataFrame({"cell": [",".join(map(str, c)) for c in cells],
                            "value": [n if not c else float(v[c[0]] if len(c) == 1 else g[c]) for c in cells]})
    return run


def _moment_cells(m: int) -> list[tuple]:
    return [(), *((i,) for i in range(m)), *((i, j) for i in range(m) for j in range(i, m))]


def _source_moments(features, gold: str, gap: float):
    """Kernel of ``pair_moments`` for one larger source: in ascending gold order the
    worse rows of a row are the first ones, so their sums are prefix sums."""
    cells = _moment_cells(len(features))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(gold)
        y = rows[gold].to_numpy(dtype=np.float64)
        x = [rows[f].to_numpy(dtype=np.float64) for f in features]
        x = [c - c.mean() for c in x]               # differences stay, sums lose fewer digits
        k = pairstats.partners(y, y, gap, strict=True)

        def worse(v):
            return np.concatenate(([0.0], np.cumsum(v)))[k]

        below = [worse(c) for c in x]
        values = []
        for c in cells:
            if not c:
                values.append(float(k.sum()))
            elif len(c) == 1:
                values.append(float((k * x[c[0]] - below[c[0]]).sum()))
            else:
                i, j = c
                values.append(float((k * x[i] * x[j] - x[i] * below[j] - x[j] * below[i] + worse(x[i] * x[j])).sum()))
        return pd.DataFrame({"cell": [",".join(map(str, c)) for c in cells], "value": values})
    return run


def pair_moments(df: DataFrame, features, gold: str = "score", gap: float = MIN_GAP) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all preference pairs (same source, gold more than ``gap`` apart; d =
    features of the better row - those of the worse): number, sum of d, sum of d d'.
    Rows that lack gold or a feature are in no pair.  Pairs of small sources are
    streamed, larger ones up to BLOCK_POINTS rows take one kernel call; beyond that
    every sum is a weighted dominance count."""
    features = list(features)
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (gold, *features)]
    sources = Sources(df.where(functools.reduce(lambda a, b: a & b, whole)), features, gold)
    cells = sources.small.mapInPandas(_small_moments(features, gap), "cell string, value double")
    huge = None
    if sources.n_big:
        mid, huge, _ = pairstats.split_tiers(sources.big, ["doc_id"], pairstats.BLOCK_POINTS, None)
        cells = cells.unionByName(mid.groupBy("doc_id").applyInPandas(_source_moments(features, gold, gap), "cell string, value double"))
    if huge is not None:
        def weight(factors):
            return functools.reduce(lambda a, b: a * b, [F.col(features[i]) for i in factors], F.lit(1.0))

        terms = _pair_terms(len(features))
        base = huge.withColumn("_g", F.col(gold).cast("double"))
        sides = []
        for t, at, which in ((1, F.col("_g"), 3), (0, pairstats.cut_column("_g", gap, strict=True, above=True), 2)):
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), weight(x[which]).alias("w")) for k, x in enumerate(terms)]))
            rows = base.select("doc_id", at.alias("a"), each.alias("x")).groupBy("doc_id", "x.term", "a").agg(F.sum("x.w").alias("w"))
            sides.append(rows.withColumns({"t": F.lit(t), "b": F.lit(0.0)}))
        found = pairstats.dominance(sides[0].unionByName(sides[1]), ["doc_id", "term"], use_b=False)
        cell = F.element_at(F.array(*[F.lit(",".join(map(str, x[0]))) for x in terms]), F.col("term") + 1)
        sign = F.element_at(F.array(*[F.lit(float(x[1])) for x in terms]), F.col("term") + 1)
        cells = cells.unionByName(found.select(cell.alias("cell"), (sign * F.col("d1")).alias("value")))
    m = len(features)
    n, v, g = 0.0, np.zeros(m), np.zeros((m, m))
    for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():       # a row a cell
        at = tuple(int(i) for i in r["cell"].split(",") if i)
        if not at:
            n = r["value"]
        elif len(at) == 1:
            v[at[0]] = r["value"]
        else:
            g[at] = g[at[::-1]] = r["value"]
    return n, v, g


def all_pairs_ranker(df: DataFrame, features, gold: str = "score", gap: float = MIN_GAP, alpha: float = RIDGE_ALPHA,
                     out: str = "ranker_score"):
    """Linear scorer that puts the better row of every preference pair one ahead:
    least squares of w.d - 1 over all pairs plus alpha w.w, from ``pair_moments``
    (no pair rows, no sample).  A row that lacks a feature has no score.  Returns
    ``(df plus out, weights)``."""
    features = list(features)
    _, v, g = pair_moments(df, features, gold, gap)
    w = np.linalg.solve(g + alpha * np.eye(len(features)), v)
    score = functools.reduce(lambda a, b: a + b, [nan_to_null(f) * F.lit(float(c)) for f, c in zip(features, w)])
    weights = df.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, w)], "feature string, weight double")
    return df.withColumn(out, score), weights


def pairwise_ranker(pairs: DataFrame, rows: DataFrame, features, out: str = "ranker_score",
                    reg: float = 0.0):
    """Linear scorer trained to order preference pairs: logistic regression
    without intercept on feature differences (better - worse labelled 1,
    mirrored 0).  ``pairs`` carries ``<f>_better``/``<f>_worse`` columns (a
    bounded sample); the score is ``w . x`` on ``rows``."""
    diff = [(F.col(f"{f}_better") - F.col(f"{f}_worse")).alias(f) for f in features]
    pos = pairs.select(*diff).withColumn("label", F.lit(1.0))
    neg = pairs.select(*[(-F.col(f"{f}_better") + F.col(f"{f}_worse")).alias(f) for f in features]) \
        .withColumn("label", F.lit(0.0))
    train = VectorAssembler(inputCols=list(features), outputCol="_x").transform(pos.unionByName(neg))
    model = LogisticRegression(featuresCol="_x", labelCol="label", fitIntercept=False,
                               regParam=reg, maxIter=100).fit(train)
    w = model.coefficients.toArray()
    score = None
    for f, c in zip(features, w):
        term = F.col(f) * F.lit(float(c))
        score = term if score is None else score + term
    spark = rows.sparkSession
    wdf = spark.createDataFrame([(f, float(c)) for f, c in zip(features, w)], "feature string, weight double")
    return rows.withColumn(out, score), wdf
