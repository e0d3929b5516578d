"""Isotonic regression of many groups at once, without a group in one task.

Points (group, x, weight, sum) are collapsed by x and sorted by ranges over all
groups together.  Inside a partition neighbours that fall are pooled; then the
last pool of every partition is compared with the first of the next (one row a
partition on the driver).  While some pair of them falls, the pools - fewer
now - are cut at other places and pooled again, which merges across the old
borders.  Pooling neighbours in any order gives the same fit.

Every pool carries the place and value of the next one, so a value is looked
up by its last pool alone: pools and rows are sorted together, a task reads
them in a stream, and the pool that a partition begins with comes from the
partitions before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EACH = 1000                 # pools of a partition at least, after the first pass
PATIENT = 8                 # passes before the number of partitions is halved
POOLS = "lp string, f long, lo double, hi double, w double, s double"
KEY = ["lp", "f", "lo"]


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools of the sorted points or pools of a partition; the stack holds those
    of one group."""
    stack, group = [], None

    def out():
        return pd.DataFrame(stack, columns=["lp", "f", "lo", "hi", "w", "s"])

    for rows in batches:
        for p in rows[["lp", "f", "lo", "hi", "w", "s"]].itertuples(index=False, name=None):
            if p[:2] != group:
                if stack:
                    yield out()
                stack, group = [], p[:2]
            lo, hi, w, s = p[2:]
            while stack and stack[-1][5] * w > s * stack[-1][4]:        # the mean before is larger
                q = stack.pop()
                lo, w, s = q[2], w + q[4], s + q[5]
            stack.append((*group, lo, hi, w, s))
    if stack:
        yield out()


def _ends(pools: DataFrame) -> list:
    """(partition, first pool, last pool, pools) of the partitions in order."""
    row = F.struct(*KEY, "hi", "w", "s")
    return sorted(pools.groupBy("_pid").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_pid"])


def pools(points: DataFrame) -> tuple[DataFrame, list]:
    """Pools of ``points`` (lp, f, lo, hi, w, s; an x of a group once), sorted over
    partitions and persisted, and the first and last pool of each."""
    n, step, held = _parts(points), 0, None
    while True:
        cut = points.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
        new = cut.mapInPandas(_pooled, POOLS).withColumn("_pid", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
        ends = _ends(new)
        if held is not None:
            held.unpersist()
        falls = any(a["last"]["lp"] == b["first"]["lp"] and a["last"]["f"] == b["first"]["f"]
                    and a["last"]["s"] * b["first"]["w"] > b["first"]["s"] * a["last"]["w"] for a, b in zip(ends[:-1], ends[1:]))
        if not falls:
            return new, ends
        held, points, step = new, new.drop("_pid"), step + 1
        # other places of the cuts each time, and enough pools between them to merge
        n = max(1, min(_parts(points), sum(r["n"] for r in ends) // EACH) >> step // PATIENT)
        n += step % 2 if n > 1 else 0


STEPS = "lp string, f long, lo double, hi double, value double, next_lo double, next_value double"


def steps(pooled: DataFrame, ends: list) -> DataFrame:
    """Pools with the next pool of their group, and before the first one of a
    group a pool from minus infinity with its value."""
    border = {}
    for i, r in enumerate(ends):
        border[r["_pid"]] = (tuple(ends[i - 1]["last"])[:2] if i else None, tuple(ends[i + 1]["first"]) if i + 1 < len(ends) else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, before, after = None, None, None
        for rows in batches:
            out = []
            for p in rows[["lp", "f", "lo", "hi", "w", "s", "_pid"]].itertuples(index=False, name=None):
                if waiting is None:
                    before, after = border[p[6]]
                else:
                    before = waiting[:2]
                    out.append(_step(waiting, p))
                if p[:2] != before:
                    out.append((p[0], p[1], -np.inf, p[2], p[5] / p[4], None, None))
                waiting = p
            if out:
                yield pd.DataFrame(out, columns=STEP_COLUMNS).astype(FLOATS)
        if waiting is not None:
            yield pd.DataFrame([_step(waiting, after)], columns=STEP_COLUMNS).astype(FLOATS)
    return pooled.mapInPandas(run, STEPS)


STEP_COLUMNS = ["lp", "f", "lo", "hi", "value", "next_lo", "next_value"]
FLOATS = {c: "float64" for c in STEP_COLUMNS[2:]}


def _step(p: tuple, after: tuple | None) -> tuple:
    same = after is not None and tuple(after[:2]) == p[:2]
    return (*p[:4], p[5] / p[4], after[2] if same else None, after[5] / after[4] if same else None)


def looked_up(rows: DataFrame, step_table: DataFrame, out: str) -> DataFrame:
    """``rows`` (row_id, lp, f, x) with an x plus the fitted value there: that of its
    pool, the straight line between two pools, the end values beyond them; null in
    groups without a pool."""
    asked = rows.select("lp", "f", F.col("x").alias("lo"), *[F.lit(None).cast("double").alias(c) for c in STEP_COLUMNS[3:]],
                        F.lit(1).alias("kind"), "row_id").where(F.col("lo").isNotNull())
    known = step_table.withColumns({"kind": F.lit(0), "row_id": F.lit(None).cast(rows.schema["row_id"].dataType)})
    both = known.unionByName(asked)
    # equal values of x are cut between partitions by their rows
    order = [*KEY, "kind", "row_id"]
    cut = both.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order) \
        .withColumn("_pid", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    last = F.max(F.when(F.col("kind") == 0, F.struct(*STEP_COLUMNS)))
    ends = sorted((r["_pid"], r["last"]) for r in cut.groupBy("_pid").agg(last.alias("last")).collect())    # a row a partition
    before, at = {}, None
    for pid, pool in ends:
        before[pid] = at
        at = tuple(pool) if pool is not None else at
    id_type = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, begun = None, False
        for b in batches:
            if not len(b):
                continue
            if not begun:
                carry, begun = before[b["_pid"].iloc[0]], True
            table = b[STEP_COLUMNS].copy()
            if carry is not None:
                table = pd.concat([pd.DataFrame([carry], columns=STEP_COLUMNS).astype(FLOATS), table], ignore_index=True)
            pool = np.concatenate(([True] * (carry is not None), b["kind"].to_numpy() == 0)).astype(bool)
            place = np.maximum.accumulate(np.where(pool, np.arange(len(pool)), -1))
            ask = np.flatnonzero(~pool)
            found = place[ask]
            x = table["lo"].to_numpy()[ask]
            lp, f = table["lp"].to_numpy(), table["f"].to_numpy()
            ok = (found >= 0) & (lp[found] == lp[ask]) & (f[found] == f[ask])
            hi, v, nlo, nv = (table[c].to_numpy(dtype=np.float64)[found] for c in ("hi", "value", "next_lo", "next_value"))
            with np.errstate(invalid="ignore", divide="ignore"):
                line = v + (nv - v) * (x - hi) / (nlo - hi)
            got = np.where((x <= hi) | np.isnan(nlo), v, line)
            if pool.any():
                carry = tuple(table.iloc[int(np.flatnonzero(pool)[-1])])
            yield pd.DataFrame({"row_id": b.loc[b["kind"] == 1, "row_id"].to_numpy(), "lp": lp[ask], "f": f[ask], "x": x,
                                out: np.where(ok, got, np.nan)})

    found = cut.mapInPandas(run, f"row_id {id_type}, lp string, f long, x double, `{out}` double")
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))
