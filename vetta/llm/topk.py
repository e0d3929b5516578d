"""Exact top-k search by a three-phase uniform threshold.

A score is the sum of ``LISTS`` partial scores, one for each slice of the
components.  Rows lie in blocks, queries in blocks, and one task meets one
block of each (a grid; both sides of a cell are bounded).

1. In every cell each slice lists its ``k`` best partial scores of each query;
   the exact scores of the listed rows give each query the k-th best score of
   the cells' lists: a safe cutoff, as at least k rows reach it.
2. The cutoff goes to every cell.  A row whose partial scores all stay below
   cutoff / LISTS cannot reach the cutoff, so the other rows suffice.
3. Their remaining partial scores are added where the row lies, and the rows
   that reach the cutoff are ranked.

Scores are exact: integer components whose products stay below 2^53 are
multiplied as doubles, larger ones as Python integers.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; equal rows count once, of
several vectors with one id the largest (as arrays compare) counts; ties go to
the smaller id; vectors of another length than the query's are no candidates;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta.llm.common import staged

LISTS = 4                       # slices of the components
ROW_BLOCK = 8192                # rows in a block, on average
QUERY_BLOCK = 1024              # queries in a block, on average
STEP = 128                      # queries multiplied at once in a task
EXACT = 2.0 ** 53


def usable(vector: Column) -> Column:
    """Vectors without null, NaN or infinite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def _grid(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with the cells (r, q) of the grid they belong to."""
    row_blocks = max(1, math.ceil(vectors.count() / ROW_BLOCK))
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def block(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    rows = vectors.withColumn("r", block(row_blocks, "row")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("q", block(query_blocks, "query")).withColumn(
        "r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    return rows, asked


def _matrix(col) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: row numbers and their matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(off)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, flat[off[rows][:, None] + np.arange(d)]))
    return out


def _pairs(rows: pa.Table, asked: pa.Table):
    """Row ids, query numbers, and partial scores (query, slice, row) for each
    vector length and step of queries."""
    row_ids = rows.column("id").to_numpy()
    ask = dict((m.shape[1], (at, m)) for at, m in _matrix(asked.column("vector")))
    for at, m in _matrix(rows.column("vector")):
        if m.shape[1] not in ask:
            continue
        query_at, queries = ask[m.shape[1]]
        exact = np.abs(m).max(initial=0) * np.abs(queries).max(initial=0) * m.shape[1] < EXACT
        cuts = np.linspace(0, m.shape[1], min(LISTS, m.shape[1]) + 1).astype(int)
        for begin in range(0, len(queries), STEP):
            part = queries[begin:begin + STEP]
            if exact:
                scores = np.stack([part[:, a:b] @ m[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:])], axis=1)
            else:
                big, many = part.astype(object), m.astype(object)
                to_int = np.vectorize(int, otypes=[object])
                scores = np.stack([to_int(big[:, a:b]) @ to_int(many[:, a:b]).T
                                   for a, b in zip(cuts[:-1], cuts[1:])], axis=1)
            yield row_ids[at], query_at[begin:begin + STEP], scores


def _out(query, ids, score) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                     "score": pa.array([int(s) for s in score], pa.int64())})


def _empty() -> list:
    return [np.zeros(0, np.int64)] * 3


SCHEMA = "query_id long, vec_id long, score long"


def local_lists(k: int):
    """Phase one in a cell: exact scores of the rows on any slice's list."""
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [_empty()]
        query_ids = asked.column("id").to_numpy()
        for ids, at, scores in _pairs(rows, asked):
            total = scores.sum(axis=1)
            for i, q in enumerate(query_ids[at]):
                own = np.flatnonzero(ids != q)
                listed = [own[_best(s[own], k)] for s in scores[i]] + [own[_best(total[i][own], k)]]
                rank = np.unique(np.concatenate(listed))
                rank = rank[_best(total[i][rank], k)]
                found.append([np.full(len(rank), q), ids[rank], total[i][rank]])
        return _out(*[np.concatenate(x) for x in zip(*found)])
    return run


def _best(values: np.ndarray, k: int) -> np.ndarray:
    if len(values) <= k:
        return np.arange(len(values))
    if values.dtype == object:
        return np.array(sorted(range(len(values)), key=lambda i: -values[i])[:k])
    return np.argpartition(-values, k - 1)[:k]


def sufficient_entries(k: int):
    """Phases two and three in a cell: rows with a partial score of at least the
    cutoff's share, resolved; of those that reach the cutoff the k best."""
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [_empty()]
        query_ids = asked.column("id").to_numpy()
        cutoffs = asked.column("cutoff").to_pylist()
        for ids, at, scores in _pairs(rows, asked):
            lists = scores.shape[1]
            for i, a in enumerate(at):
                cut = cutoffs[a]
                if cut is None:                     # fewer than k rows: all suffice
                    enough = np.arange(len(ids))
                else:
                    enough = np.flatnonzero((scores[i] * lists >= cut).any(axis=0))
                total = scores[i][:, enough].sum(axis=0)
                keep = ids[enough] != query_ids[a]
                if cut is not None:
                    keep &= np.asarray(total >= cut, dtype=bool)
                kept, total = ids[enough][keep], total[keep]
                if len(kept) > k:                   # many ties: the smallest ids of the best
                    best = np.array(sorted(range(len(kept)), key=lambda j: (-total[j], kept[j]))[:k])
                    kept, total = kept[best], total[best]
                found.append([np.full(len(kept), query_ids[a]), kept, total])
        return _out(*[np.concatenate(x) for x in zip(*found)])
    return run


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query with their ranks; the rank filter lets
    Spark cut every query to k entries in each partition before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
                 .select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best candidates of each query by inner product: ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score``.  Both inputs have ``id`` (long) and
    ``vector`` (array of doubles with integer values); a query's own id is no
    candidate of its."""
    def clean(df: DataFrame) -> DataFrame:
        good = df.select("id", "vector").where(F.col("id").isNotNull() & usable(F.col("vector")))
        return good.groupBy("id").agg(F.max("vector").alias("vector"))

    vectors, queries = staged(clean(vectors), "vectors"), staged(clean(queries), "queries")
    rows, asked = _grid(vectors, queries)
    first = (rows.groupBy("r", "q").cogroup(asked.groupBy("r", "q")).applyInArrow(local_lists(k), SCHEMA))
    kth = ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("cutoff"))
    cut = staged(asked.join(kth, F.col("id") == F.col("of"), "left").select("r", "q", "id", "vector", "cutoff"), "cutoffs")
    enough = rows.groupBy("r", "q").cogroup(cut.groupBy("r", "q")).applyInArrow(sufficient_entries(k), SCHEMA)
    return ranked(enough, k)
