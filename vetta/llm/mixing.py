"""Mixing sources to target weights by capped water-filling, DataFrame
functions only.

Every source has a weight and a size; the mix shares ``share`` times all sizes
in proportion to the weights, but no source gives more than ``max_epochs``
times its size.  Sources above their cap are clamped to it and what they leave
is shared again by weight, until none is above.  A source with target t and
size s repeats each document floor(t / s) times; the rest of t is filled with
whole documents taken in a seeded order: documents fall into ``SLOTS`` hash
slots, slots are taken in order while the rest is not filled, and the slot
that crosses the rest is taken when that comes nearer.  Every document gets
whole repetitions, at most ``max_epochs``.

Only per-source and per-(source, slot) sums move, so a source with a third of
all rows is summed map-side first.  The order is a pure function of seed and
id: reruns and recomputed partitions agree.

Defined cases: a null text has size 0; a null source is a source of its own
(last in order); a null id is ordered as the text "null"; equal rows are taken
alike; with no words at all every target is 0; an empty table gives an empty
result; input columns stay as they are (added columns that clash get
underscores in front).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta.llm.common import free_name, staged

WEIGHTS = (5, 2, 1)             # by source in code point order, repeating
SHARE = 1.5                     # size of the mix, as a share of all sizes
MAX_EPOCHS = 2
SLOTS = 4096                    # three hex digits of the seeded hash
SEED = "mix"
ADDED = ("source_size", "target", "repeats")


def slot(id_value: Column, seed: str = SEED) -> Column:
    """Seeded slot of a document, 0 to SLOTS - 1."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(id_value.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")


def ranked_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``weight`` of each source by its rank in code point order, null last.
    Ranks come from a range sort: rows before in other partitions plus rows
    before in the own one."""
    spread = staged(sources.withColumn("last", F.col("source").isNull())
                    .repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "sources")
    parts = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    rank = F.col("before") + own - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return spread.join(F.broadcast(before), "part").select("source", "size", weight.cast("long").alias("weight"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` of each (source, size, weight) row.  A round that clamps
    nobody new ends the loop; clamped sources stay clamped, so it ends."""
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * share
    level = 0.0                 # target per weight unit of the open sources
    while True:
        over = F.col("weight") * F.lit(level) > F.col("size") * max_epochs
        clamped, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("size") * max_epochs)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if not open_weight or (total - clamped) / open_weight <= level:
            break
        level = (total - clamped) / open_weight
    over = F.col("weight") * F.lit(level) > F.col("size") * max_epochs
    return sources.withColumn("target", F.when(over, F.col("size").cast("double") * max_epochs)
                              .otherwise(F.col("weight") * F.lit(level)))


def mix(df: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """``df`` plus ``source_size``, ``target`` (both of its source) and
    ``repeats``, the whole number of times the mix takes the row."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(source_col).alias("source"),
                     F.col(size_col).cast("long").alias("words"), slot(F.col(id_col), seed).alias("slot"))
    slots = staged(rows.groupBy("source", "slot").agg(F.sum("words").alias("words")), "slots")
    sources = slots.groupBy("source").agg(F.sum("words").alias("size"))
    plan = staged(water_fill(staged(ranked_weights(sources, weights), "weights"), share, max_epochs), "targets")

    whole = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("size")))
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("slot"))   # at most SLOTS rows
    cut = (slots.withColumn("upto", so_far)
           .join(plan.select(F.col("source").alias("of"), "size", "target", "whole", "rest"),
                 F.col("source").eqNullSafe(F.col("of")))
           # the slot counts when at least half of it lies below the rest
           .select("source", "slot", "size", "target",
                   (F.col("whole") + ((F.col("upto") - F.col("words") / 2.0) < F.col("rest")).cast("int")).alias("times")))
    source_size, target, repeats = (free_name(df, c) for c in ADDED)
    cut = cut.select(F.col("source").alias("of"), F.col("slot").alias("of_slot"), "size", "target", "times")
    return (rows.join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("of_slot")))
            .select("row.*", F.col("size").alias(source_size), F.col("target").alias(target),
                    F.least(F.col("times"), F.lit(max_epochs)).alias(repeats)))
