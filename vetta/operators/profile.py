"""Profiles of a segment table: score distribution, histogram, value counts,
grouped score statistics, document structure, text lengths, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetta.functions.text import word_count
from vetta.operators.rank import nan_to_null
from vetta.plans.ordered import exact_quantiles, positions_in_group

HIST_BINS = 10
HIST_BAR_WIDTH = 40
SCALE_SWITCH = 1.5         # max > 1.5 means a 0-100 scale


def score_profile(df: DataFrame, col: str = "score") -> DataFrame:
    """n, min, max, mean, median, std (population), p25, p75."""
    base = df.select(nan_to_null(col).alias("v")).filter(F.col("v").isNotNull())
    # the three quantiles attach as one scalar subquery (no join)
    q = exact_quantiles(base, "v", [0.5, 0.25, 0.75]).select(F.struct("q0", "q1", "q2")).scalar()
    return base.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
                    F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).select(
        "n", "min", "max", "mean", q["q0"].alias("median"), "std", q["q1"].alias("p25"),
        q["q2"].alias("p75"))


def score_histogram(df: DataFrame, col: str = "score") -> DataFrame:
    """Ten bins over 0-100, or 0-1 when max <= 1.5; last bin closed, values
    outside dropped; empty bins kept; a '#' bar of count*40 // max count."""
    base = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    top = base.agg(F.when(F.max("v") > SCALE_SWITCH, F.lit(100.0)).otherwise(F.lit(1.0))).scalar()
    wide = top > 1
    # inner edges are i*10 (0-100) or i/10 (0-1), as in the explicit bin lists
    inner = F.when(wide, F.array(*[F.lit(float(i * 10)) for i in range(1, HIST_BINS)])) \
        .otherwise(F.array(*[F.lit(i / 10) for i in range(1, HIST_BINS)]))
    # the edge array is a column first: subqueries cannot sit inside a lambda
    binned = base.filter((F.col("v") >= 0) & (F.col("v") <= top)).withColumn("_inner", inner).select(
        F.size(F.filter("_inner", lambda e: e <= F.col("v"))).alias("bin"))
    hits = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    bins = spark.createDataFrame(
        [(i, float(i * 10), float(i * 10 + 10), i / 10, (i + 1) / 10) for i in range(HIST_BINS)],
        "bin int, lo100 double, hi100 double, lo1 double, hi1 double")
    edges = bins.select("bin", F.when(wide, F.col("lo100")).otherwise(F.col("lo1")).alias("lo"),
                        F.when(wide, F.col("hi100")).otherwise(F.col("hi1")).alias("hi"))
    out = edges.join(hits, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    mx = hits.agg(F.max("count")).scalar()
    # count * 40 // max count (exact: both are integers)
    width = F.when(mx > 0, F.floor(F.col("count") * HIST_BAR_WIDTH / mx)).otherwise(F.lit(0))
    return out.select("bin", "lo", "hi", "count", F.repeat(F.lit("#"), width.cast("int")).alias("bar"))


def value_counts(df: DataFrame, dims: dict) -> DataFrame:
    """Counts per value of several dimensions in one grouping-sets pass:
    ``dimension, value, count, rank`` (most common first, ties by value)."""
    cols = [c.alias(name) for name, c in dims.items()]
    names = list(dims)
    g = df.select(*cols).groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]) \
        .agg(F.count(F.lit(1)).alias("count"), *[F.grouping(n).alias(f"_g_{n}") for n in names])
    parts = []
    for n in names:
        others = [F.col(f"_g_{o}") == 1 for o in names if o != n]
        cond = F.col(f"_g_{n}") == 0
        for o in others:
            cond = cond & o
        parts.append(g.filter(cond).select(F.lit(n).alias("dimension"),
                                           F.col(n).cast("string").alias("value"), "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # ranking a handful of aggregated values per dimension
    w = Window.partitionBy("dimension").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return out.withColumn("rank", F.row_number().over(w))


def stats_by(df: DataFrame, keys, col: str = "score") -> DataFrame:
    """n, mean, median, std (population), min, max per group."""
    keys = list(keys)
    base = df.select(*keys, nan_to_null(col).alias("v")).filter(F.col("v").isNotNull())
    agg = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
                                  F.stddev_pop("v").alias("std"), F.min("v").alias("min"),
                                  F.max("v").alias("max"))
    med = exact_quantiles(base, "v", [0.5], by=keys)
    return agg.join(med, keys, "left").select(*keys, "n", "mean", F.col("q0").alias("median"),
                                              "std", "min", "max")


def doc_structure(df: DataFrame) -> DataFrame:
    """Distinct sources, rows, and mean rows per source (the reference's
    group count and mean systems per source)."""
    return df.agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("rows_per_doc", F.col("n_rows") / F.col("n_docs"))


def length_stats(df: DataFrame, cols=("src_text", "tgt_text")) -> DataFrame:
    """Word-count mean, median, min, max per text column."""
    parts = []
    for c in cols:
        wc = df.select(word_count(c).alias("v")).filter(F.col("v").isNotNull())
        med = exact_quantiles(wc, "v", [0.5]).select("q0").scalar()
        parts.append(wc.agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
                     .select(F.lit(c).alias("column"), "mean", med.alias("median"),
                             F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_examples(df: DataFrame, col: str = "score", key: str = "row_id", k: int = 5,
                   preview: int = 150, text_cols=("text",)) -> DataFrame:
    """Five lowest, five highest and five around the median (positions
    mid-2..mid+2, mid = n // 2) in (score, key) order, with text previews."""
    base = df.filter(F.col(col).isNotNull()).select(key, col).withColumn("_all", F.lit(0))
    p = positions_in_group(base, ["_all"], col, [key])
    mid = F.floor(F.col("_gn") / 2)
    lo = p.filter(F.col("_gpos") < k).withColumn("kind", F.lit("lowest"))
    hi = p.filter(F.col("_gpos") >= F.col("_gn") - k).withColumn("kind", F.lit("highest"))
    md = p.filter((F.col("_gpos") >= mid - 2) & (F.col("_gpos") <= mid + 2)).withColumn("kind", F.lit("median"))
    out = lo.unionByName(hi).unionByName(md)
    previews = [F.substring(c, 1, preview).alias(f"{c}_preview") for c in text_cols]
    # at most 2k + 5 chosen rows meet the texts
    chosen = F.broadcast(out.select("kind", F.col("_gpos").alias("position"), key, col))
    return df.select(key, *text_cols).join(chosen, key).select("kind", "position", key, col, *previews)


def head_rows(df: DataFrame, key: str = "row_id", n: int = 20, cols=("doc_id",)) -> DataFrame:
    """First ``n`` rows in key order (storage order is not stable in Spark)."""
    return df.select(key, *cols).orderBy(key).limit(n)
