"""Pairs of the rows of small sources, streamed in bounded runs.

``small_sources`` puts the rows of each source beside each other in one
partition (hash of the source, sorted), so a task reads whole sources from a
stream of batches and never holds more than one batch of rows and ``RUN_PAIRS``
pairs.  Steps that look at the same pairs again persist them ``packed``: a run is
one row of arrays, so a pass takes runs to Python and not row after row.

Pairs of larger sources are dealt out as pairs of blocks of their distinct points
(``block_pairs``): any two blocks of a source meet in one task, which holds these
two and ``RUN_PAIRS`` pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_PAIRS = 1 << 17        # pairs in memory at once
WHOLE = 512                # rows of a source whose pairs fit in a run
BLOCK = 4096               # points of a block of a larger source, more where it would have over
BLOCKS = 32                # so many (each point goes to as many tasks), but
MOST_POINTS = 1 << 20      # so many of a block at most
HUGE = 1e300               # differences of smaller values are finite
PACKED = "x binary, y binary, fold binary, size binary"


def small_sources(base: DataFrame, parts: int) -> DataFrame:
    """``base`` (``doc_id``, ``_y``, signals, perhaps ``fold``) with the rows of a
    source beside each other."""
    return base.repartition(parts, "doc_id").sortWithinPartitions("doc_id")


@dataclass
class Run:
    """Some whole sources of two rows and more, and their pairs: rows ``left``
    and ``right`` of each pair, first pair of each source."""

    x: np.ndarray           # rows x signals
    y: np.ndarray
    fold: np.ndarray        # of each source
    n_pairs: np.ndarray     # of each source
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray
    whole: bool = False     # no row lacks a value and all gold is finite

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, fold: np.ndarray, size: np.ndarray, whole: bool = False) -> Run:
        """The run of sources of ``size`` rows that lie one after the other."""
        n_pairs = size * (size - 1) // 2
        upto = np.cumsum(size)
        # for each row the number of later rows of its source
        later = np.repeat(upto, size) - 1 - np.arange(len(x))
        left = np.repeat(np.arange(len(x)), later)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
        return cls(x, y, fold, n_pairs, np.cumsum(n_pairs) - n_pairs, left, right, whole)

    def per_source(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first, axis=0)

    def difference(self, values: np.ndarray) -> np.ndarray:
        """Of each pair, 0 where there is none."""
        d = values[self.left] - values[self.right]
        return d if self.whole and np.abs(values).max() < HUGE else np.nan_to_num(d)

    @property
    def source(self) -> np.ndarray:
        """Number of the source of each pair."""
        return np.repeat(np.arange(len(self.n_pairs)), self.n_pairs)


def _cuts(rows: pd.DataFrame, signals: list[str]) -> Iterator[tuple]:
    """What makes the runs of the whole sources of ``rows``."""
    doc = rows["doc_id"].to_numpy()
    n = len(rows)
    if not n:
        return
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return
    x = np.column_stack([rows[s].to_numpy(dtype=np.float64, na_value=np.nan) for s in signals])
    y = rows["_y"].to_numpy(dtype=np.float64, na_value=np.nan)
    fold = rows["fold"].to_numpy(dtype=np.int64) if "fold" in rows.columns else np.zeros(n, dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(size * (size - 1) // 2)))
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + RUN_PAIRS, "right")) - 1)
        own = size[a:b]
        row = np.arange(own.sum()) + np.repeat(start[a:b] - np.cumsum(own) + own, own)
        yield x[row], y[row], fold[start[a:b]], own
        a = b


def _cuts_of(batches: Iterator[pd.DataFrame], signals: list[str]) -> Iterator[tuple]:
    """The same for a partition of ``small_sources``; the last source of a batch
    waits for the next one, which may go on with it."""
    rest = None
    for rows in batches:
        if rest is not None and len(rest):
            rows = pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        doc = rows["doc_id"].to_numpy()
        other = np.flatnonzero(doc != doc[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        yield from _cuts(rows.iloc[:cut], signals)
        rest = rows.iloc[cut:]
    if rest is not None:
        yield from _cuts(rest, signals)


def runs(batches: Iterator[pd.DataFrame], signals: list[str]) -> Iterator[Run]:
    """Runs of a partition of ``small_sources``."""
    for cut in _cuts_of(batches, signals):
        yield Run.of(*cut)


def packed(small: DataFrame, signals: list[str]) -> DataFrame:
    """The runs of ``small_sources`` as rows of arrays.  Sources that lack a value or
    have one gold value only are left out: no blend has a tau there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, y, fold, size in _cuts_of(batches, signals):
            first = np.cumsum(size) - size
            gap = np.isnan(x).any(axis=1) | np.isnan(y)
            use = ~np.logical_or.reduceat(gap, first) & (np.fmin.reduceat(y, first) < np.fmax.reduceat(y, first))
            if use.any():
                row = np.repeat(use, size)
                yield pd.DataFrame({"x": [x[row].tobytes()], "y": [y[row].tobytes()], "fold": [fold[use].tobytes()],
                                    "size": [size[use].astype(np.int64).tobytes()]})
    return small.mapInPandas(run, PACKED)


def packed_runs(batches: Iterator[pd.DataFrame]) -> Iterator[Run]:
    """Runs of a partition of ``packed``."""
    for rows in batches:
        for x, y, fold, size in rows[["x", "y", "fold", "size"]].itertuples(index=False, name=None):
            y, size = np.frombuffer(y), np.frombuffer(size, dtype=np.int64)
            # two infinite gold values have no difference
            yield Run.of(np.frombuffer(x).reshape(len(y), -1), y, np.frombuffer(fold, dtype=np.int64), size, bool(np.isfinite(y).all()))


def points(rows: DataFrame, signals: list[str]) -> DataFrame:
    """Distinct points of the sources of ``rows`` (as for ``small_sources``) and how
    many rows each has (``_c``); sources without a tau are left out as in ``packed``."""
    fold = ["fold"] if "fold" in rows.columns else []
    pts = rows.groupBy("doc_id", *fold, "_y", *signals).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    gap = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("_y", *signals)])
    has = pts.groupBy("doc_id").agg(F.max(gap).alias("_gap"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"),
                                    F.count(F.lit(1)).alias("_m"))
    pts = pts.join(has.where(~F.col("_gap") & (F.col("_lo") < F.col("_hi"))).select("doc_id", "_m"), "doc_id")
    return pts if fold else pts.withColumn("fold", F.lit(0).cast("long"))


def source_pairs(pts: DataFrame) -> DataFrame:
    """``doc_id, fold, pairs, unlike``: all pairs of each source of ``points`` and those
    whose gold differs."""
    pairs = F.col("_s") * (F.col("_s") - 1) / 2
    same = pts.groupBy("doc_id", "fold", "_y").agg(F.sum("_c").alias("_s"))
    return same.groupBy("doc_id", "fold").agg(F.sum("_s").alias("_n"), F.sum(pairs).alias("_ties")) \
        .select("doc_id", "fold", (F.col("_n") * (F.col("_n") - 1) / 2).alias("pairs"),
                (F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_ties")).alias("unlike"))


def block_pairs(pts: DataFrame, signals: list[str], parts: int) -> DataFrame:
    """Every two blocks of a source of ``points`` as a row of arrays, the rows of the
    first block (``n_left`` of them) before those of the second; a block with itself
    has ``n_left`` -1.  ``head`` marks one row of each source."""
    n = F.greatest(F.least(F.ceil(F.col("_m") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("_m") / MOST_POINTS))
    dealt = pts.withColumn("_n", n.cast("int")).withColumn("_own", F.pmod(F.xxhash64("_y", *signals), F.col("_n")).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))) \
        .withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(rows["_a"].iloc[0]), int(rows["_b"].iloc[0])
        own = rows["_own"].to_numpy()
        order = np.argsort(own, kind="stable")
        x = rows[signals].to_numpy(dtype=np.float64)[order]
        y, c = (rows[v].to_numpy(dtype=np.float64)[order] for v in ("_y", "_c"))
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].to_numpy(), "fold": [int(rows["fold"].iloc[0])], "head": [b == 0],
                             "n_left": [-1 if a == b else int((own == a).sum())], "x": [x.tobytes()], "y": [y.tobytes()],
                             "c": [c.tobytes()]})
    doc = pts.schema["doc_id"].dataType.simpleString()
    dealt = dealt.select("doc_id", "fold", "_y", *signals, "_c", "_own", "_a", "_b").repartition(parts, "doc_id", "_a", "_b")
    return dealt.groupBy("doc_id", "_a", "_b").applyInPandas(
        pack, f"doc_id {doc}, fold long, head boolean, n_left int, x binary, y binary, c binary")


def block_runs(n_left: int, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``block_pairs`` whose gold differs, some at a time: places of
    their two points."""
    n = len(y) if n_left < 0 else n_left
    a = 0
    while a < n:
        first = a + 1 if n_left < 0 else n_left
        z = min(n, a + max(1, RUN_PAIRS // max(1, len(y) - first)))
        unlike = y[a:z, None] != y[None, first:]
        if n_left < 0:
            unlike &= np.arange(a, z)[:, None] < np.arange(first, len(y))[None, :]
        left, right = np.nonzero(unlike)
        if len(left):
            yield left + a, right + first
        a = z


@dataclass
class Signs:
    """Sign of the gold difference of each pair, ties of each source, and which
    sources have a value everywhere."""

    gold: np.ndarray
    gold_ties: np.ndarray
    whole: np.ndarray


def signs(run: Run) -> Signs:
    gold = np.sign(run.y[run.left] - run.y[run.right])
    if run.whole:
        whole = np.ones(len(run.n_pairs), dtype=bool)
    else:
        gap = np.isnan(run.x[run.left]).any(axis=1) | np.isnan(run.x[run.right]).any(axis=1) | np.isnan(gold)
        whole = run.per_source(gap.astype(np.int64)) == 0
    return Signs(np.nan_to_num(gold), run.per_source((gold == 0).astype(np.float64)), whole)


def partitions(df: DataFrame, n_rows: int, rows_each: int) -> int:
    """Partitions for ``n_rows`` rows: the session's number, more for many rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows_each))


def source_sizes(base: DataFrame, limit: int):
    """(sizes, all rows, number of sources of more than ``limit`` rows)."""
    sizes = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    n_rows, n_big = sizes.agg(F.sum("_n"), F.count_if(F.col("_n") > limit)).first()
    return sizes, int(n_rows or 0), n_big
