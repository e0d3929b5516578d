"""Target-distribution importance resampling.

A document's weight says how much likelier its word runs are in a target
corpus than in the documents: each run of 1 to ``n`` words falls into one of
``buckets`` buckets (crc32 of its bytes), a bucket's gain is the floored
logarithm of the ratio of its smoothed frequencies, and gains add up over the
runs.  Two passes over the texts: bucket counts, summed by Spark (their number
is a parameter, so the table of gains is of fixed size), then array-scored
weights.  Gumbel noise from a hash of the id turns the highest scores into a
draw without replacement.

The cut is found without sorting all rows: a distributed quickselect draws
pivot keys at random from the rows still in question, one job counts the rows
below, at and above each pivot, and the range shrinks until a pivot is the
k-th key.  The composite key (score descending, id, hash of the text, row
number) is unique.  Only the winners are sorted, by ranges, and ranked by the
counts of the ranges before theirs.

Defined cases: a null or empty text has no words, no runs and weight 0; a null
id hashes as the word ``null`` and comes last among equal scores; repeated ids
share their noise, equal rows are ranked one after the other; an empty target
or an empty table counts 0 everywhere and the result has the usual columns;
input columns stay as they are (added columns that clash get underscores in
front), only the text is left out unless ``keep_text``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.llm.common import free_name, staged
from vetta.llm.words import PLAIN, Words, byte_slices, split_words

BUCKETS = 10_000
MAX_WORDS = 3                   # words of the longest run
LEAST_WORDS = 20                # shorter documents are not drawn
SEED = 42
PIVOTS = 24                     # keys whose places one job counts
SLICE_BYTES = 1 << 20           # text handled at once in a task
SHORT = 64                      # longer words are hashed one by one
POLYNOMIAL = 0xEDB88320         # of crc32
ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


BYTE = _byte_table()


def _step(state: np.ndarray, byte: np.ndarray | int = 0) -> np.ndarray:
    return BYTE[(state ^ np.uint32(byte) if np.isscalar(byte) else state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _advance_table() -> np.ndarray:
    """A register after L zero bytes is the xor of four entries, one for each of
    its bytes: table[L, k, byte]."""
    out = np.empty((SHORT + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        out[n + 1] = _step(out[n])
    return out


ADVANCE = _advance_table()


def _advance(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after ``n`` zero bytes each."""
    while True:
        k = np.minimum(n, SHORT)
        state = (ADVANCE[k, 0, state & 255] ^ ADVANCE[k, 1, (state >> 8) & 255]
                 ^ ADVANCE[k, 2, (state >> 16) & 255] ^ ADVANCE[k, 3, state >> 24])
        n = n - k
        if not n.any():
            return state


def _word_registers(w: Words) -> np.ndarray:
    """Register of each word from a start of zero (crc32 is linear, so the
    register from any other start is that start, advanced, xor this one)."""
    size = w.end - w.start
    out = np.zeros(len(size), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT, "left"))
    for i in order[:long]:
        out[i] = zlib.crc32(w.data[w.start[i]:w.end[i]].tobytes())
    if long:
        i = order[:long]
        out[i] ^= ONES ^ _advance(np.full(long, ONES), size[i])
    rest = order[long:]
    at, state = w.start[rest], np.zeros(len(rest), dtype=np.uint32)
    smaller = -size[rest]
    for j in range(int(size[rest[0]]) if len(rest) else 0):
        m = int(np.searchsorted(smaller, -j, "left"))           # words of more than j bytes
        state[:m] = _step(state[:m], w.data[at[:m] + j].astype(np.uint32))
    out[rest] = state
    return out


def run_buckets(w: Words, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, bucket) of the runs of 1, 2 .. ``n`` consecutive words of a row."""
    word, size = _word_registers(w), w.end - w.start
    state = _advance(np.full(len(word), ONES), size) ^ word
    first = np.arange(len(word))
    for k in range(1, n + 1):
        yield first, (state ^ ONES) % np.uint32(buckets)
        inside = first[first + k < len(word)]
        inside = inside[w.row[inside] == w.row[inside + k]]
        state = _advance(_step(state[np.searchsorted(first, inside)], 0x20), size[inside + k]) ^ word[inside + k]
        first = inside


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of the word runs of all texts; every task sums its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for begin, end in byte_slices(batch.column(0), SLICE_BYTES):
                for _, at in run_buckets(split_words(batch.column(0).slice(begin, end - begin), PLAIN), n, buckets):
                    counts += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    return df.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket (both tables have ``buckets`` rows at most)."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for out, table in ((s, counts), (t, target)):
        for row in table.collect():
            out[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
                     for a, b in zip(s, t)], dtype=np.int64)


def with_weights(df: DataFrame, gain: np.ndarray, text_col: str = "text", n: int = MAX_WORDS) -> DataFrame:
    """``df`` plus ``n_words``, ``n_features`` and ``weight``."""
    names = [free_name(df, c) for c in ("n_words", "n_features", "weight")]
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = np.zeros((3, batch.num_rows), dtype=np.int64)
            for begin, end in byte_slices(batch.column(text_col), SLICE_BYTES):
                w = split_words(batch.column(text_col).slice(begin, end - begin), PLAIN)
                own = added[:, begin:end]
                own[0] = w.n_words
                for first, at in run_buckets(w, n, len(gain)):
                    upto = np.searchsorted(first, w.first)      # runs before each row
                    own[1] += np.diff(upto)
                    own[2] += np.diff(np.concatenate(([0], np.cumsum(gain[at])))[upto])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(seed:id)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _below(keys: list[str], values, strict: bool = True) -> Column:
    """Whether the composite key of a row comes before ``values`` (or is it)."""
    out = F.lit(not strict)
    for c, v in reversed(list(zip(keys, values))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) composite key of ``rows``, a staged table whose
    keys are unique and not null; None where there are fewer rows."""
    low = high = None
    before, step = 0, 0
    while k > 0:
        inside = rows
        if low is not None:
            inside = inside.where(~_below(keys, low, strict=False))
        if high is not None:
            inside = inside.where(_below(keys, high))
        found = sorted(tuple(r) for r in inside.select(*keys).orderBy(F.xxhash64(*keys, F.lit(step)), *keys)
                       .limit(pivots).collect())                # at most ``pivots`` keys
        if not found:
            return None
        counts = inside.agg(*[F.count_if(_below(keys, p)).alias(f"n{i}") for i, p in enumerate(found)]).first()
        passed = 0
        for p, less in zip(found, counts):
            if before + less + 1 == k:
                return p
            if before + less >= k:              # the k-th key comes before this pivot
                high = p
                break
            low, passed = p, less + 1
        before += passed
        step += 1
    return None


def ranked(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """``rows`` plus their places (from 1) in the order of ``keys``: sorted by
    ranges, and the sizes of the ranges before added (one number a range)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, at = free_name(rows, "part"), free_name(rows, "at")
    cut = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    cut = staged(cut.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "winners")
    sizes = sorted((r[0], r[1]) for r in cut.groupBy(part).count().collect())
    upto = np.cumsum([0] + [n for _, n in sizes]).tolist()
    offsets = spark.createDataFrame([(p, n) for (p, _), n in zip(sizes, upto)], f"`{part}` int, `{rank}` long")
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return (cut.join(F.broadcast(offsets), part)                # one row a range
            .withColumn(rank, F.col(rank) + inside + 1).drop(part, at))


def resample(df: DataFrame, target: DataFrame, percent: int = 5, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", n: int = MAX_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """``df`` plus ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``
    (from 1; null where a row is not drawn): of the rows with at least
    ``least_words`` words, ``percent`` of a hundred are drawn, rounded down."""
    gain = gains(bucket_counts(df, text_col, n, buckets), bucket_counts(target, target_col, n, buckets), buckets)
    scored = with_weights(df, gain, text_col, n)
    n_words, _, weight = scored.columns[-3:]
    score, rank = free_name(df, "score"), free_name(df, "rank")
    keys = [free_name(df, c) for c in ("k_score", "k_null", "k_id", "k_text", "k_row")]
    scored = scored.withColumn(score, F.col(weight) + noise(F.col(id_col), seed))
    scored = scored.withColumns({
        keys[0]: -F.col(score), keys[1]: F.col(id_col).isNull().cast("int"),
        keys[2]: F.coalesce(F.col(id_col), F.lit(0).cast(df.schema[id_col].dataType)),
        keys[3]: F.xxhash64(text_col), keys[4]: F.monotonically_increasing_id()})
    scored = staged(scored if keep_text else scored.drop(text_col), "scores")
    fit = scored.where(F.col(n_words) >= least_words)
    last = kth_key(fit, keys, percent * fit.count() // 100)
    if last is None:
        return scored.drop(*keys).withColumn(rank, F.lit(None).cast("long"))
    drawn = (F.col(n_words) >= least_words) & _below(keys, last, strict=False)
    winners = ranked(scored.where(drawn), keys, rank).drop(*keys)
    return winners.unionByName(scored.where(~drawn).drop(*keys).withColumn(rank, F.lit(None).cast("long")))
