"""Order statistics without a single-partition window.

``with_position`` numbers rows in a total order the way ``zipWithIndex``
does: range-partition and sort, count rows per partition (one small action,
one number per partition), then add the partition's offset to the row's index
inside its partition.  Exact quantiles, medians, average ranks and snake
orders are built on it, so none of them collects a group into one task or
keeps a per-group value map in memory (as ``percentile`` does).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW33 = (1 << 33) - 1


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_position(df: DataFrame, order: list, pos: str = "_pos") -> DataFrame:
    """Add a 0-based ``pos`` column: the row's place in ``order`` (a list of
    column names or Columns; include a unique key to make it total)."""
    s = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)
    s = s.withColumn("_pid", F.spark_partition_id()) \
         .withColumn("_mid", F.monotonically_increasing_id()) \
         .persist(StorageLevel.MEMORY_AND_DISK)
    counts = sorted((r["_pid"], r["count"]) for r in s.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid, c in counts:
        offsets.append((pid, acc))
        acc += c
    off = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return s.join(F.broadcast(off), "_pid").withColumn(
        pos, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33))).drop("_pid", "_mid", "_off")


def positions_in_group(df: DataFrame, by: list, value: str, tie: list | None = None) -> DataFrame:
    """Rows with ``_gpos`` (0-based place inside its group by ``value`` then
    ``tie``) and ``_gn`` (group size).  ``by`` must be non-empty."""
    by = list(by)
    p = with_position(df, [*by, value, *(tie or [])])
    g = p.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_gn"))
    return p.join(g, by).withColumn("_gpos", F.col("_pos") - F.col("_first")) \
        .drop("_first", "_pos")


def value_places(df: DataFrame, value: str, by: list) -> DataFrame:
    """``by``, value, ``_c`` (rows that hold it), ``_lo`` (rows of the group
    with smaller values) and ``_gn`` (rows of the group).  Equal values are one
    row before the sort, so a frequent value never fills a task."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    run = with_prefix_sum(counts, [*[F.col(k) for k in by], F.col(value)], "_c", "_before")
    group = run.groupBy(*by).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_gn"))
    return run.join(group, by).withColumn("_lo", F.col("_before") - F.col("_first")).drop("_before", "_first")


def exact_quantiles(df: DataFrame, value: str, probs, by=(), prefix: str = "q") -> DataFrame:
    """Linear-interpolation quantiles (NumPy's default) per group, exact.

    Returns ``by + [f"{prefix}{i}" ...]`` one row per group; nulls and NaN
    are ignored."""
    by = list(by)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    d = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull())
    keys = by or ["_g"]
    p = value_places(d if by else d.withColumn("_g", F.lit(0)), "_v", keys)
    aggs, need = [], F.lit(False)
    for i, q in enumerate(probs):
        h = (F.col("_gn") - 1) * F.lit(float(q))
        at = [(F.col("_lo") <= x) & (x < F.col("_lo") + F.col("_c")) for x in (F.floor(h), F.ceil(h))]
        low, high = (F.max(F.when(c, F.col("_v"))) for c in at)
        aggs.append((low + (high - low) * F.max(h - F.floor(h))).alias(f"{prefix}{i}"))
        need = need | at[0] | at[1]
    agg = p.filter(need).groupBy(*keys).agg(*aggs)      # only the values that hold a needed place
    return agg if by else agg.drop("_g")


def sd(col: str, ddof: int) -> Column:
    return F.stddev_pop(col) if ddof == 0 else F.stddev_samp(col)


def with_prefix_sum(df: DataFrame, order: list, weight: str, out: str = "_before") -> DataFrame:
    """Exclusive running sum of ``weight`` in ``order`` over the whole table.

    Range-partitioned sort; per-partition totals (one number per partition)
    give each partition its starting offset; inside a partition an
    Arrow-batched ``mapInPandas`` accumulates in order, carrying the sum
    across batches."""
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext
    from pyspark.sql import types as T

    s = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    totals = {r["_pid"]: float(r["_t"] or 0.0) for r in
              s.groupBy(F.spark_partition_id().alias("_pid")).agg(
                  F.sum(F.col(weight).cast("double")).alias("_t")).collect()}
    offsets, acc = {}, 0.0
    for pid in sorted(totals):
        offsets[pid] = acc
        acc += totals[pid]
    bc = df.sparkSession.sparkContext.broadcast(offsets)
    schema = T.StructType(s.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches):
        carry = bc.value.get(TaskContext.get().partitionId(), 0.0)
        for pdf in batches:
            w = pdf[weight].to_numpy(dtype=np.float64, na_value=0.0)
            cs = np.cumsum(w)
            pdf[out] = carry + cs - w
            if len(w):
                carry += float(cs[-1])
            yield pd.DataFrame(pdf)

    return s.mapInPandas(run, schema)
