"""Error analysis of a signal: per-source detail, tau distribution, worst
sources, Spearman of source properties, gold quintiles, pairwise agreement,
compression, cross-signal agreement and top disagreements."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.operators import pairstats, rank
from vetta.plans.ordered import exact_quantiles, value_places

GOLD = "score"
TIE_BAND = 1.0             # gold gaps below this are ties in the agreement analysis
TAU_PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
N_QUANTILE_BINS = 5


def per_source_detail(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    """One row per (signal, source) with a defined tau: tau, n_systems, gold
    and predicted range and mean, and the language pair of the source's first
    row (by row key)."""
    t = rank.tau_by_group(df, signals, ["doc_id"], gold).filter(F.col("tau").isNotNull())
    g = rank.nan_to_null(gold)
    aggs = [(F.max(g) - F.min(g)).alias("gold_range"), F.avg(g).alias("gold_mean"),
            F.min_by("src_lang", "row_id").alias("src_lang"), F.min_by("tgt_lang", "row_id").alias("tgt_lang")]
    for i, s_ in enumerate(signals):
        p = rank.nan_to_null(s_)
        aggs += [(F.max(p) - F.min(p)).alias(f"_r{i}"), F.avg(p).alias(f"_m{i}")]
    # one wide aggregation per source, then one row per signal
    wide = df.groupBy("doc_id").agg(*aggs)
    stack = ", ".join(f"'{s_}', _r{i}, _m{i}" for i, s_ in enumerate(signals))
    stats = wide.select("doc_id", "gold_range", "gold_mean", "src_lang", "tgt_lang",
                        F.expr(f"stack({len(signals)}, {stack}) AS (signal, pred_range, pred_mean)"))
    return t.join(stats, ["doc_id", "signal"]).select(
        "signal", "doc_id", "tau", F.col("n").alias("n_systems"), "gold_range", "pred_range",
        "gold_mean", "pred_mean", "src_lang", "tgt_lang")


def tau_distribution(detail: DataFrame) -> DataFrame:
    """n, mean, median, sample std, min, max and P10..P90 of per-source tau."""
    detail = detail.persist()      # read by the moments and by the sort
    agg = detail.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n_sources"), F.avg("tau").alias("mean"),
        F.stddev_samp("tau").alias("std"), F.min("tau").alias("min"), F.max("tau").alias("max"))
    q = exact_quantiles(detail, "tau", TAU_PERCENTILES, by=["signal"])
    names = [f"p{int(round(p * 100))}" for p in TAU_PERCENTILES]
    q = q.select("signal", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    return agg.join(q, "signal").withColumn("median", F.col("p50"))


def worst_sources(detail: DataFrame, k: int = 10, signals=None) -> DataFrame:
    """Lowest-tau sources per signal (ties by doc id).  ``k`` is the report
    size.  Each signal is a partial top-k (per-partition candidates, then
    k rows), never a window holding all sources of a signal in one task."""
    if signals is None:
        signals = [r["signal"] for r in detail.select("signal").distinct().collect()]
    out = None
    for sig in signals:
        top = detail.filter(F.col("signal") == sig).orderBy(F.asc("tau"), F.asc("doc_id")).limit(k)
        out = top if out is None else out.unionByName(top)
    # ranking k rows per signal
    w = Window.partitionBy("signal").orderBy(F.asc("tau"), F.asc("doc_id"))
    return out.withColumn("rank", F.row_number().over(w))


def worst_drilldown(df: DataFrame, worst: DataFrame, signal: str, k: int = 3,
                    gold: str = GOLD) -> DataFrame:
    """Rows of the ``k`` worst sources of one signal, best gold first."""
    docs = worst.filter((F.col("signal") == signal) & (F.col("rank") <= k)).select("doc_id", "rank")
    rows = df.join(F.broadcast(docs), "doc_id")   # at most k keys
    w = Window.partitionBy("doc_id").orderBy(F.desc(gold), F.asc("row_id"))
    return rows.withColumn("pos", F.row_number().over(w)).select(
        F.col("rank").alias("worst_rank"), "doc_id", "pos", "row_id", "tgt_system", gold, signal)


def spearman_props(detail: DataFrame, props=("n_systems", "gold_range", "pred_range", "gold_mean")):
    """Spearman r of each source property against tau with its two-sided p,
    per signal: Pearson of average ranks.  All properties are unpivoted into
    one table, so two distributed rank passes over the different values serve
    every (signal, property)."""
    stack = ", ".join(f"'{p}', CAST(`{p}` AS DOUBLE)" for p in props)
    by = ["signal", "property"]
    detail = detail.select("signal", "tau", *props).persist()      # read by the points and by both rank passes
    base = detail.select("signal", F.col("tau").alias("y"),
                         F.expr(f"stack({len(props)}, {stack}) AS (property, x)")).dropna()
    ranked = base.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    for c in ("x", "y"):
        places = value_places(base.select(*by, c), c, by)
        ranked = ranked.join(places.select(*by, c, (F.col("_lo") + (F.col("_c") + 1) / 2).alias(f"r{c}")), [*by, c])
    n, w = F.sum("w"), F.col("w")
    dx, dy = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid")
    # ranks average (n + 1) / 2 with any ties
    size = ranked.groupBy(*by).agg(((n + 1) / 2).alias("mid"))
    sums = ranked.join(size, by).groupBy(*by).agg(
        n.alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    out = sums.select(*by, "n", r.alias("spearman_r"))
    return out.withColumn("pvalue", spearman_p("spearman_r", "n"))


@F.pandas_udf(T.DoubleType())
def spearman_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """``spearman_pvalue`` of each report row."""
    return pd.Series([np.nan if x != x else spearman_pvalue(float(x), int(k)) for x, k in zip(r.astype(float), n)],
                     dtype=float)


def spearman_pvalue(r: float, n: int) -> float | None:
    """Two-sided p of a Spearman r from the t distribution with n-2 degrees
    of freedom (what SciPy reports); computed on the driver from two numbers."""
    if r is None or n is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    df_ = n - 2
    t = r * math.sqrt(df_ / (1.0 - r * r))
    x = df_ / (df_ + t * t)
    return _betainc(df_ / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(math.log(x) * a + math.log(1 - x) * b + lbeta)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 300):
        for k in (0, 1):
            if k == 0:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * f / a


def lp_tau_breakdown(detail: DataFrame) -> DataFrame:
    """Per signal and language pair: mean tau, source count, median gold range."""
    detail = detail.select("signal", "src_lang", "tgt_lang", "tau", "gold_range").persist()      # read by the means and by the sort
    agg = detail.groupBy("signal", "src_lang", "tgt_lang").agg(
        F.avg("tau").alias("mean_tau"), F.count(F.lit(1)).alias("n_sources"))
    med = exact_quantiles(detail, "gold_range", [0.5], by=["signal", "src_lang", "tgt_lang"])
    return agg.join(med, ["signal", "src_lang", "tgt_lang"]).withColumnRenamed(
        "q0", "median_gold_range")


def gold_quintiles(df: DataFrame, signals, gold: str = GOLD, bins: int = N_QUANTILE_BINS) -> DataFrame:
    """Equal-frequency gold bins (right-closed, lowest value included,
    duplicate edges dropped); per bin: gold mean/min/max, prediction mean and
    sample std for each signal."""
    base = df.select(rank.nan_to_null(gold).alias("g"), *[rank.nan_to_null(s).alias(s) for s in signals]).filter(F.col("g").isNotNull())
    probs = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(base, "g", probs)
    edges = q.select(F.array_distinct(F.array_sort(F.array(*[F.col(f"q{i}") for i in range(bins + 1)])))) \
        .scalar()
    # the edge array is a column first: subqueries cannot sit inside a lambda
    b = base.withColumn("_e", edges).withColumn(
        "bin", F.size(F.filter(F.slice("_e", 2, bins + 1), lambda e: e < F.col("g"))))
    lg = b.select("bin", "g", F.expr(
        f"stack({len(signals)}, " + ", ".join(f"'{s}', CAST(`{s}` AS DOUBLE)" for s in signals)
        + ") AS (signal, pred)"))
    return lg.groupBy("signal", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("g").alias("gold_mean"), F.min("g").alias("gold_min"),
        F.max("g").alias("gold_max"), F.avg("pred").alias("pred_mean"),
        F.stddev_samp("pred").alias("pred_std"))


def pair_agreement(df: DataFrame, signals, gold: str = GOLD, band: float = TIE_BAND) -> DataFrame:
    """Within-source pairs: tie if the gold gap is below ``band``, else agree
    when the prediction orders them the same way, else disagree.  Counted per
    source without building pairs, then summed."""
    out = None
    for s in signals:
        ag = pairstats.band_agreement(df.filter(F.col("doc_id").isNotNull()), ["doc_id"], gold, s, band)
        tot = ag.agg(F.sum("agree").alias("agree"), F.sum("disagree").alias("disagree"),
                     F.sum("tie").alias("tie")).withColumn("signal", F.lit(s))
        out = tot if out is None else out.unionByName(tot)
    total = F.col("agree") + F.col("disagree") + F.col("tie")
    return out.select("signal", total.cast("long").alias("total_pairs"),
                      F.col("agree").cast("long").alias("agree"),
                      F.col("disagree").cast("long").alias("disagree"),
                      F.col("tie").cast("long").alias("tie"),
                      (F.col("agree") / total * 100).alias("agree_pct"),
                      (F.col("disagree") / total * 100).alias("disagree_pct"),
                      (F.col("tie") / total * 100).alias("tie_pct"))


def compression_ratio(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    """Sample std of each prediction over the sample std of gold."""
    gstd = df.agg(F.stddev_samp(rank.nan_to_null(gold))).scalar()
    lg = rank.long_signals(df, signals, [], gold)
    p = lg.groupBy("signal").agg(F.stddev_samp("pred").alias("pred_std"))
    return p.select("signal", gstd.alias("gold_std"), "pred_std",
                    F.when(gstd > 0, F.col("pred_std") / gstd).alias("compression_ratio"))


def signal_summary(df: DataFrame, signals) -> DataFrame:
    lg = rank.long_signals(df, signals, [], signals[0])
    return lg.groupBy("signal").agg(
        F.count("pred").alias("n"), F.min("pred").alias("min"), F.max("pred").alias("max"),
        F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("std_pop"),
        F.stddev_samp("pred").alias("std_samp"))


def signal_pairs(signals):
    return [(a, b) for i, a in enumerate(signals) for b in signals[i + 1:]]


def cross_signal(df: DataFrame, signals) -> DataFrame:
    """Pearson and tau for every pair of signals (rows with both present)."""
    out = None
    for a, b in signal_pairs(signals):
        d = df.select(rank.nan_to_null(a).alias("a"), rank.nan_to_null(b).alias("b")).dropna()
        tau = pairstats.concordance(d, [], "b", ["a"]).select("tau").scalar()
        r = d.agg(rank.pearson_expr("a", "b").alias("pearson")).select(
            F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), "pearson", tau.alias("kendall_tau"))
        out = r if out is None else out.unionByName(r)
    return out


def signal_disagreement(df: DataFrame, signals, k: int = 5, gold: str = GOLD) -> DataFrame:
    """Rows where two z-scored signals (sample std) differ most, per pair."""
    clean = df.select("row_id", gold, *[rank.nan_to_null(s).alias(s) for s in signals])
    moments = df.agg(F.struct(*[x for s in signals for x in (
        F.avg(rank.nan_to_null(s)).alias(f"m_{s}"), F.stddev_samp(rank.nan_to_null(s)).alias(f"s_{s}"))]).alias("_m")).scalar()
    z = clean.withColumn("_m", moments)

    def score(s):
        return (F.col(s) - F.col(f"_m.m_{s}")) / F.col(f"_m.s_{s}")
    # each pair keeps the first k rows of every partition while it reads; ranking
    # the rows of all pairs together would sort them, several times the table
    out = None
    for a, b in signal_pairs(signals):
        top = z.select(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), "row_id", gold, F.col(a).cast("double").alias("value_a"),
                       F.col(b).cast("double").alias("value_b"), F.abs(score(a) - score(b)).alias("diff")) \
            .orderBy(F.desc_nulls_last("diff"), F.asc("row_id")).limit(k)
        out = top if out is None else out.unionByName(top)
    return out


EXACT_P_ROWS = 33               # larger samples use the normal approximation


def inversion_tails(n: int) -> np.ndarray:
    """Two-sided p of every number of discordant pairs among ``n`` untied
    items.  The permutations of n items with d inversions: item n goes to any
    of n places and adds 0 to n - 1 inversions to those of n - 1 items."""
    ways = np.ones(1)
    for items in range(2, n + 1):
        ways = np.convolve(ways, np.full(items, 1.0 / items))
    upto = np.cumsum(ways)
    d = np.arange(len(ways))
    low = np.minimum(d, len(ways) - 1 - d)
    return np.minimum(1.0, np.where(2 * low == len(ways) - 1, 1.0, 2 * upto[low]))


def _extreme_p(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The same for at most one discordant pair and any n: 1 or n of n!
    permutations (by logarithms, so no factorial overflows)."""
    items = np.where(d == 0, n, n - 1).astype(int)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(2, items.max(initial=1)) + 1)))))
    return np.minimum(1.0, 2 * np.exp(-logs[np.maximum(items, 0)]))


def _kendall_p_rows(pdf) -> np.ndarray:
    """p of each row (n, s, tie sums): exact without ties up to EXACT_P_ROWS
    rows or at the extremes, else the tie-corrected normal approximation."""
    n = pdf["n"].to_numpy(float)
    s = pdf["s"].to_numpy(dtype=float, na_value=np.nan)
    tx, ty, x0, x1, y0, y1 = (pdf[c].to_numpy(dtype=float, na_value=0.0) for c in ("tx", "ty", "x0", "x1", "y0", "y1"))
    total = n * (n - 1) / 2
    m = n * (n - 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m + np.where(n > 2, x0 * y0 / (9 * m * (n - 2)), 0.0)
        z = np.abs(s) / np.sqrt(var)
    out = np.where(var > 0, [math.erfc(v) if v == v else np.nan for v in z / math.sqrt(2)], np.nan)
    known = ~np.isnan(s) & (n >= 2)
    d = np.where(known, np.round((total - np.nan_to_num(s)) / 2), 0)
    low = np.minimum(d, total - d)
    plain = known & (tx == 0) & (ty == 0)
    for size in np.unique(n[plain & (n <= EXACT_P_ROWS)]).astype(int):     # at most EXACT_P_ROWS tables
        at = plain & (n == size)
        out[at] = inversion_tails(size)[d[at].astype(int)]
    at = plain & (n > EXACT_P_ROWS) & (low <= 1)
    out[at] = _extreme_p(n[at], low[at])
    return np.where(known, out, np.nan)


@F.pandas_udf(T.DoubleType())
def kendall_p(n: pd.Series, s: pd.Series, tx: pd.Series, ty: pd.Series, x0: pd.Series,
              x1: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
    pdf = pd.DataFrame({"n": n, "s": s, "tx": tx, "ty": ty, "x0": x0, "x1": x1, "y0": y0, "y1": y1})
    return pd.Series(_kendall_p_rows(pdf))


def per_source_pvalues(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    """Per-source tau with its p-value as SciPy reports it by default: exact
    permutation p without ties for n <= 33, else the normal approximation
    with tie corrections.  Tie sums come from value-count aggregations; the
    p-value is an Arrow-batched helper over one row per source."""
    c = pairstats.concordance(df, ["doc_id"], gold, signals).filter(F.col("tau").isNotNull())
    known = df.filter(F.col("doc_id").isNotNull())

    def tie_sums(rows, by, col, pfx):
        t = rows.groupBy(*by, col).agg(F.count(F.lit(1)).cast("double").alias("t"))
        return t.groupBy(*by).agg(
            F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias(f"{pfx}0"),
            F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias(f"{pfx}1"))
    # gold ties are the same for every signal
    pred = tie_sums(rank.long_signals(known, signals, ["doc_id"], gold), ["doc_id", "signal"], "pred", "x")
    own = tie_sums(known.select("doc_id", rank.nan_to_null(gold).alias("gold")), ["doc_id"], "gold", "y")
    j = c.join(pred, ["doc_id", "signal"]).join(own, "doc_id")

    return j.select("signal", "doc_id", "tau",
                    kendall_p("n", "s", "tx", "ty", "x0", "x1", "y0", "y1").alias("pvalue"))
