"""Rank statistics of predicted-score columns against a gold column.

All functions take a segment DataFrame and a list of signal columns and
return long-form DataFrames (one row per signal and scope), so every signal is
evaluated in the same pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetta.operators import pairstats

GOLD = "score"
SPA_THRESHOLD = 25.0       # fixed tie band of soft pairwise accuracy
LP_SEP = "->"


TIE_NUDGE = 1e-9


def r6(c) -> Column:
    """Round a double to 6 places for cross-engine comparison.  A 1e-9 nudge
    first moves values that sit exactly on a rounding tie (means of
    5-decimal data) off it, so last-ulp summation noise cannot flip them."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(TIE_NUDGE), 6)


def lp_label(sep: str = LP_SEP) -> Column:
    return F.concat(F.col("src_lang"), F.lit(sep), F.col("tgt_lang"))


def nan_to_null(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def long_signals(df: DataFrame, signals, keep, gold: str = GOLD) -> DataFrame:
    """Unpivot signals to ``keep + [signal, pred, gold]`` (NaN read as null)."""
    stack = ", ".join(f"'{s}', CAST(`{s}` AS DOUBLE)" for s in signals)
    return df.select(*keep, nan_to_null(gold).alias("gold"),
                     F.expr(f"stack({len(signals)}, {stack}) AS (signal, pred)")) \
        .withColumn("pred", nan_to_null("pred"))


# --- per-group tau ----------------------------------------------------------

def tau_by_group(df: DataFrame, signals, keys=("doc_id",), gold: str = GOLD) -> DataFrame:
    """Tau-b per group and signal: ``keys + [signal, n, tau]`` (tau null when
    undefined)."""
    res = pairstats.concordance(df, list(keys), gold, list(signals))
    return res.select(*keys, "signal", "n", "tau")


def mean_tau(tau_df: DataFrame, by=(), signals=None, scopes: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of defined taus per ``by + signal``; 0.0 where no group
    is defined.  ``scopes`` (rows of ``by``) lists scopes that must appear."""
    by = list(by)
    agg = tau_df.groupBy(*by, "signal").agg(F.avg("tau").alias("_m"),
                                           F.count("tau").alias("n_groups"))
    if signals is not None:
        # every scope gets every signal: explode the literal list, no join
        base = tau_df.sparkSession.range(1) if scopes is None else scopes
        frame = base.select(*by, F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal"))
        agg = frame.join(agg, by + ["signal"], "left")
    return agg.select(*by, "signal", F.coalesce("_m", F.lit(0.0)).alias("tau"),
                      F.coalesce("n_groups", F.lit(0)).alias("n_groups"))


def kendall_per_source(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    t = tau_by_group(df, signals, ["doc_id"], gold)
    return mean_tau(t, signals=signals).select(
        "signal", r6("tau").alias("per_source_tau"), F.col("n_groups").alias("n_docs"))


def kendall_per_lp(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    d = df.withColumn("lp", lp_label())
    t = tau_by_group(d, signals, ["lp", "doc_id"], gold)
    lps = d.select("lp").filter(F.col("lp").isNotNull()).distinct()
    return mean_tau(t, ["lp"], signals, lps).select(
        "lp", "signal", r6("tau").alias("per_source_tau"), F.col("n_groups").alias("n_docs"))


def kendall_overall(df: DataFrame, signals, gold: str = GOLD, by=()) -> DataFrame:
    """Overall tau-b per signal over rows where both sides are present."""
    by = list(by)
    lg = long_signals(df, signals, by, gold).dropna(subset=["pred", "gold"])
    res = pairstats.concordance(lg.withColumnRenamed("signal", "sig"), by + ["sig"], "gold", ["pred"],
                                few_groups=True)
    return res.select(*by, F.col("sig").alias("signal"), "n", "tau")


# --- linear correlation ------------------------------------------------------

def pearson_expr(x: str, y: str) -> Column:
    """covar_pop / (sd_pop * sd_pop); null on a constant side (built-in
    ``corr`` raises under ANSI division)."""
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den > 0, F.covar_pop(x, y) / den)


def pearson(df: DataFrame, signals, gold: str = GOLD, by=()) -> DataFrame:
    by = list(by)
    lg = long_signals(df, signals, by, gold).dropna(subset=["pred", "gold"])
    return lg.groupBy(*by, "signal").agg(F.count(F.lit(1)).alias("n"),
                                         pearson_expr("pred", "gold").alias("pearson"))


# --- system level -------------------------------------------------------------

def system_means(df: DataFrame, signals, gold: str = GOLD, by=()) -> DataFrame:
    by = list(by)
    lg = long_signals(df.filter(F.col("tgt_system").isNotNull()), signals,
                      by + ["tgt_system"], gold)
    return lg.groupBy(*by, "signal", "tgt_system").agg(F.avg("gold").alias("gold_mean"),
                                                       F.avg("pred").alias("pred_mean"))


def soft_pairwise_accuracy(df: DataFrame, signals, gold: str = GOLD, by=(),
                           threshold: float = SPA_THRESHOLD) -> DataFrame:
    """Share of system pairs where the metric agrees with humans: a pair
    agrees if the gold gap is inside the band, or if the signs of gold and
    predicted gaps match.  Fewer than two systems gives 0.0."""
    by = list(by)
    sm = system_means(df, signals, gold, by)
    ag = pairstats.band_agreement(sm, by + ["signal"], "gold_mean", "pred_mean", threshold)
    total = F.col("agree") + F.col("disagree") + F.col("tie")
    scopes = sm.select(*by, "signal").distinct()
    res = scopes.join(ag, by + ["signal"], "left")
    return res.select(*by, "signal", F.coalesce(
        F.when(total > 0, (F.col("agree") + F.col("tie")) / total), F.lit(0.0)).alias("spa"))


# --- full report ----------------------------------------------------------------

def evaluate_metric(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    """Overall tau, per-source tau, Pearson and SPA, then per-source tau,
    Pearson and SPA per language pair, as ``scope, lp, signal, metric, value``.

    Rows are exploded once to the scopes ``lp = 'all'`` and their own
    language pair, so each statistic is one pass for both scopes."""
    scoped = df.withColumn("lp", F.explode(F.array(F.lit("all"), lp_label()))) \
        .filter(F.col("lp").isNotNull())
    lps = scoped.select("lp").distinct()
    is_all = F.col("lp") == "all"
    scope = F.when(is_all, F.lit("overall")).otherwise(F.lit("lp")).alias("scope")
    per_src = mean_tau(tau_by_group(scoped, signals, ["lp", "doc_id"], gold), ["lp"], signals, lps)
    parts = [
        kendall_overall(df, signals, gold).select(F.lit("overall").alias("scope"), F.lit("all").alias("lp"),
                                                  "signal", F.lit("kendall_tau").alias("metric"),
                                                  F.col("tau").alias("value")),
        per_src.select(scope, "lp", "signal",
                       F.when(is_all, F.lit("per_source_kendall_tau")).otherwise(F.lit("kendall_tau"))
                       .alias("metric"), F.col("tau").alias("value")),
        pearson(scoped, signals, gold, ["lp"]).select(scope, "lp", "signal", F.lit("pearson").alias("metric"),
                                                     F.col("pearson").alias("value")),
        soft_pairwise_accuracy(scoped, signals, gold, ["lp"]).select(
            scope, "lp", "signal", F.lit("spa").alias("metric"), F.col("spa").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", r6("value"))


def leaderboard(df: DataFrame, signals, gold: str = GOLD) -> DataFrame:
    """Per-source tau, overall tau and SPA for each signal, with the signal's
    position in the given list (used to break ties)."""
    pos = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(signals)],
                                          "signal string, signal_order int")
    ps_ = mean_tau(tau_by_group(df, signals, ["doc_id"], gold), signals=signals) \
        .select("signal", F.col("tau").alias("per_source_tau"))
    ov = kendall_overall(df, signals, gold).select("signal", F.col("tau").alias("overall_tau"))
    spa = soft_pairwise_accuracy(df, signals, gold)
    return F.broadcast(pos).join(ps_, "signal", "left").join(ov, "signal", "left") \
        .join(spa, "signal", "left")


def best_signal(board: DataFrame) -> DataFrame:
    """Highest per-source tau; the first listed signal wins ties."""
    return board.orderBy(F.desc("per_source_tau"), F.asc("signal_order")).limit(1)
