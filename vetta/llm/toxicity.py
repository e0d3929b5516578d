"""Toxicity from class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of how words are written, one of toxic and
one of ordinary text, predict each byte of a word from the ``ORDER - 1`` before
it.  Their orders above ``SHARED`` have counts of their own class, the orders
up to ``SHARED`` have counts over both, so an expression too rare to be known
falls back to counts that say the same in both models.  A document's evidence
is by how much its words' log-likelihood under the toxic model exceeds that
under the ordinary one, for each of its words; a word counts beyond ``MARGIN``,
as smaller differences come with topic and language.  A logistic curve of the
evidence's logarithm gives a score from 0 to 1; it is fitted on labelled
documents that gave no counts.

All labelled documents outside the held-out fold take part, none is sampled;
counting is a Spark aggregation that grows with them, and every count stays, in
Spark tables (only the shared orders, 65,792 n-grams at most, are broadcast).
Each different word of the corpus is scored once: words lie in blocks of
bounded size, and a block asks one ratio for each n-gram of the highest order in
its words.  N-grams and counts meet in buckets by the two bytes before the last,
which an n-gram, its contexts and all its lower orders have in common; where more
than ``HOME_KEYS`` n-grams share them, one byte more decides, and the few counts
of contexts that are shorter than that go to all tasks (see ``Homes``).
Words beyond the margin give evidence, others none.  Of the former the
``FREQUENT`` in most slices of text are broadcast and need no shuffle; the
occurrences of the others, found by a Bloom filter, are joined with their
values.

Words are runs of ASCII letters and digits and of bytes of other scripts, A-Z
lowered; a word begins and ends with spaces.  Words are compared by 64-bit
hashes, and their values are whole multiples of 1 / ``UNIT``, so sums do not
depend on the order of rows.

Defined cases: a null text counts as empty, and a text without words has no
evidence (0); equal texts get equal scores; without labels of both classes
every score is 0.5; rows with a null label do not train; an empty table gives
an empty result; input columns stay as they are (added columns that clash get
underscores in front).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.llm import bloom
from vetta.llm import words as W
from vetta.llm.common import discard, free_name, staged
from vetta.llm.labels import train_texts

ADDED = ("evidence", "score")
ORDER = 7                       # bytes of an n-gram; at most 7 fit a signed long
SHARED = 2                      # orders up to this one count both classes together
BLOCK_BYTES = 256 << 10         # different words whose n-grams meet their counts in one task
HOME_KEYS = 1 << 18             # n-grams asked in one bucket, on average and of one home
MOST_HOMES = 2048               # ``HOME_KEYS`` grows once so many homes of one length pass it
FREQUENT = 1 << 16              # words whose values are broadcast
UNIT = 1 << 24                  # values of words are multiples of 1 / UNIT
MARGIN = 3.0                    # log-likelihood ratio a word must exceed to count
FLOOR = 1e-3                    # added to the evidence before its logarithm
DISCOUNT = 0.75                 # absolute discount of every order
CALIBRATE = 6                   # one labelled document in so many calibrates only
BINS = 4000                     # histogram of log evidence for the calibration
SLICE_BYTES = 4 << 20
SPACE = 0x20
CLASSES = ("t", "o")            # toxic and ordinary
COUNTS = ("t", "o", "kt", "ko")


def grams(w: W.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (packed bytes) that end in each byte of the chosen words and in
    the space after them, and the position in ``which`` each belongs to."""
    start, size = w.start[which], w.end[which] - w.start[which]
    room = size + ORDER                         # spaces in front and one behind
    first = np.cumsum(room) - room
    spread = np.full(int(room.sum()), SPACE, dtype=np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spread[np.repeat(first + ORDER - 1, size) + inside] = w.data[np.repeat(start, size) + inside]
    keys = np.zeros(len(spread), dtype=np.int64)
    for back in range(ORDER):
        keys[back:] |= spread[:len(spread) - back] << (8 * back)
    own = np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    return keys[np.repeat(first + ORDER - 1, size + 1) + own], np.repeat(np.arange(len(which)), size + 1)


def _split(col) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words of a column, one word index for each different word, and for every
    word the place of its like among those."""
    w = W.split_words(col, W.PLAIN)
    _, which, like = np.unique(W.word_hashes(w), return_index=True, return_inverse=True)
    return w, which, like


def count_grams(train: DataFrame) -> DataFrame:
    """(key, t, o): occurrences of each n-gram in toxic and in ordinary text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in W.byte_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                w, which, like = _split(part.column("text"))
                toxic = part.column("y").to_numpy(zero_copy_only=False) > 0
                in_toxic = np.bincount(like, weights=toxic[w.row], minlength=len(which))
                in_all = np.bincount(like, minlength=len(which))
                keys, word = grams(w, which)
                found, at = np.unique(keys, return_inverse=True)
                t = np.bincount(at, weights=in_toxic[word], minlength=len(found)).astype(np.int64)
                n = np.bincount(at, weights=in_all[word], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, t, n - t)], names=["key", "t", "o"])

    counted = train.select("text", "y").mapInArrow(run, "key long, t long, o long")
    return counted.groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def lower_order(table: DataFrame, order: int) -> DataFrame:
    """Counts one order down: the different bytes an n-gram follows; one that
    begins a word has only the space before it and keeps its occurrences."""
    key = F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1))
    begins = F.shiftrightunsigned(key, 8 * (order - 1)) == SPACE

    def counted(c: str) -> Column:
        return F.sum(F.when(begins, F.col(c)).otherwise((F.col(c) > 0).cast("long"))).alias(c)

    return table.groupBy(key.alias("key")).agg(*[counted(c) for c in CLASSES])


def contexts_of(table: DataFrame) -> DataFrame:
    """Occurrences and different n-grams of each context (the bytes before the
    last) in each class."""
    return table.groupBy(F.shiftrightunsigned("key", 8).alias("key")).agg(
        *[F.sum(c).alias(c) for c in CLASSES],
        *[F.sum((F.col(c) > 0).cast("long")).alias("k" + c) for c in CLASSES])


def _arrays(frame) -> dict:
    """Columns sorted by key."""
    frame = frame.sort_values("key")
    return {c: frame[c].to_numpy(np.int64 if c == "key" else np.float64) for c in ("key", *COUNTS)}


def _of_order(grams, contexts) -> dict:
    return {"grams": _arrays(grams), "contexts": _arrays(contexts)}


def placed(key, place: int):
    """A key with its table (twice the order, one more for contexts) in the top byte."""
    return key + (place << 56)


def train_model(train: DataFrame) -> tuple[dict, dict] | None:
    """From (id, text, y) rows the shared orders as arrays, and for the others
    staged tables of n-grams (by twice the order) and of contexts (by one more);
    None without rows of both classes."""
    table = staged(count_grams(train), "toxicity-grams")
    total = table.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    if not total.t or not total.o:
        return None
    low, high = {}, {}
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            table = staged(lower_order(table, order), f"toxicity-{order}-grams")
        if order <= SHARED:
            zero = F.lit(0).cast("long")
            both = table.select("key", (F.col("t") + F.col("o")).alias("t"), zero.alias("o"))
            low[order] = _of_order(both.select("*", zero.alias("kt"), zero.alias("ko")).toPandas(), contexts_of(both).toPandas())
        else:
            high[2 * order], high[2 * order + 1] = table, staged(contexts_of(table), f"toxicity-{order}-contexts")
    return low, high


def all_counts(high: dict) -> DataFrame:
    """Rows (key, counts) of all tables, see ``placed``."""
    rows = None
    for place, df in high.items():
        sums = [F.col(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in COUNTS]
        part = df.select(placed(F.col("key"), place).alias("key"), *sums)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _find(table: dict, keys: np.ndarray, cols: tuple) -> list[np.ndarray]:
    """Columns of a table by key; 0 for keys that it lacks."""
    if not len(table["key"]):
        return [np.zeros(len(keys)) for _ in cols]
    at = np.minimum(np.searchsorted(table["key"], keys), len(table["key"]) - 1)
    known = table["key"][at] == keys
    return [np.where(known, table[c][at], 0.0) for c in cols]


def log_ratio(model: dict, keys: np.ndarray) -> np.ndarray:
    """log p(last byte | bytes before) under the toxic minus under the ordinary
    model, for each packed n-gram."""
    likely = {c: np.full(len(keys), 1 / 256) for c in CLASSES}
    for order in range(1, ORDER + 1):
        gram = keys & ((1 << (8 * order)) - 1)
        found = _find(model[order]["grams"], gram, CLASSES)
        sums = _find(model[order]["contexts"], gram >> 8, COUNTS)
        for i, c in enumerate(CLASSES):
            j = 0 if order <= SHARED else i
            total = np.maximum(sums[j], 1)
            rest = np.where(sums[j] > 0, DISCOUNT * sums[j + 2] / total, 1.0)
            likely[c] = np.maximum(found[j] - DISCOUNT, 0) / total + rest * likely[c]
    return np.log(likely["t"] / likely["o"])


class Homes:
    """Which bucket answers for an n-gram of the highest order, and which one
    needs a count.  A home is the last ``SHARED`` bytes of a context; one in
    ``hot`` (those that more than ``HOME_KEYS`` asked n-grams share) is split by
    the byte before them, again and again up to the whole context."""

    def __init__(self, hot: dict[int, np.ndarray], buckets: int):
        self.hot, self.buckets = hot, buckets

    def find(self, context: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of contexts of the given numbers of bytes; whether a context
        ends before its home does, so that every bucket may need it."""
        depth = np.full(len(context), SHARED, np.int64)
        upper = np.zeros(len(context), bool)
        for d in range(SHARED, ORDER - 1):
            deeper = (depth == d) & ~upper & np.isin(context & ((1 << (8 * d)) - 1), self.hot.get(d, ()))
            upper |= deeper & (size == d)
            depth += deeper & (size > d)
        home = (context & ((1 << (8 * depth)) - 1)) | depth << 56
        return (W.splitmix(home.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32), upper


def homes_of(words: DataFrame) -> Homes:
    """Buckets for the n-grams of the words; one pass over the words for each
    length of a home that is hot."""
    def counted(depth: int, above: np.ndarray | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = W.split_words(batch.column("word"), W.PLAIN)
                context = np.unique(grams(w, np.arange(len(w.start)))[0]) >> 8
                if above is not None:
                    context = context[np.isin(context & ((1 << (8 * depth - 8)) - 1), above)]
                home, n = np.unique(context & ((1 << (8 * depth)) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(n)], names=["home", "n"])

        return words.select("word").mapInArrow(run, "home long, n long").groupBy("home").agg(F.sum("n").alias("n"))

    hot, above = {}, None
    for depth in range(SHARED, ORDER - 1):
        homes = staged(counted(depth, above), "toxicity-homes")
        if above is None:
            total = homes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            most = max(HOME_KEYS, total // MOST_HOMES)
        above = homes.where(F.col("n") > most).select("home").toPandas()["home"].to_numpy(np.int64)
        discard(homes)
        if not len(above):
            break
        hot[depth] = np.sort(above)
    return Homes(hot, total // most + 1)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys, compressed: bytes of their differences, place by place."""
    steps = np.diff(keys, prepend=0)
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    places = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(places.T).view(np.int64).ravel())


def different_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, slices): each different word and in how many slices it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in W.byte_slices(batch.column("text"), SLICE_BYTES):
                w, which, _ = _split(batch.column("text").slice(begin, end - begin))
                start, size = w.start[which], w.end[which] - w.start[which]
                stop = np.cumsum(size)
                at = np.arange(int(size.sum())) - np.repeat(stop - size - start, size)
                offsets = np.concatenate(([0], stop)).astype(np.int32)
                found = pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(w.data[at]))
                yield pa.RecordBatch.from_arrays([found], names=["word"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string")
    return staged(found.groupBy("word").agg(F.count("*").alias("slices")), "toxicity-words")


def in_blocks(words: DataFrame) -> DataFrame:
    """``words`` plus their block, of ``BLOCK_BYTES`` on average."""
    size = words.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    return words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(size // BLOCK_BYTES + 1)).cast("int"))


def word_values(docs: DataFrame, model: tuple[dict, dict], text_col: str = "text") -> DataFrame:
    """(word, value, slices) of the words beyond the margin: the hash, and by
    how much in multiples of 1 / UNIT."""
    low, high = model
    context = docs.sparkSession.sparkContext
    different = different_words(docs, text_col)
    homes, words = homes_of(different), in_blocks(different)
    shared = context.broadcast(low)             # at most 65,792 n-grams

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tagged = batch.column("key").to_numpy()
            table, key = tagged >> 56, tagged & ((1 << 56) - 1)
            bucket, upper = homes.find(np.where(table % 2 == 0, key >> 8, key), table // 2 - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(upper, -1, bucket).astype(np.int32)), *batch.columns],
                                             names=["bucket", *batch.schema.names])

    counts = staged(all_counts(high).mapInArrow(place, "bucket int, key long, t long, o long, kt long, ko long"), "toxicity-counts")
    discard(*high.values())
    # at most 257 rows for each hot home, of which each length has MOST_HOMES
    upper = context.broadcast(counts.where("bucket < 0").toPandas() if homes.hot else None)

    def asked_keys(part: pa.Table) -> tuple:
        w = W.split_words(part.column("word"), W.PLAIN)
        keys, word = grams(w, np.arange(len(w.start)))
        found, at = np.unique(keys, return_inverse=True)
        bucket, _ = homes.find(found >> 8, np.full(len(found), ORDER - 1))
        order = np.argsort(bucket, kind="stable")           # keys stay sorted in each
        used, begin = np.unique(bucket[order], return_index=True)
        return w, word, found, at, order, used, np.append(begin, len(order))

    def ask(part: pa.Table) -> pa.Table:
        _, _, found, _, order, used, cut = asked_keys(part)
        return pa.table({"block": pa.array(np.full(len(used), part.column("block")[0].as_py(), np.int32)),
                         "bucket": pa.array(used), "n": pa.array(np.diff(cut).astype(np.int32)),
                         "keys": pa.array([packed(found[order[a:b]]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        frame, own = known.select(["key", *COUNTS]).to_pandas(), dict(shared.value)
        if upper.value is not None:
            frame = pd.concat([frame, upper.value[["key", *COUNTS]]])
        tagged = frame["key"].to_numpy(np.int64)
        frame["key"] = tagged & ((1 << 56) - 1)
        for order in range(SHARED + 1, ORDER + 1):
            own[order] = _of_order(*(frame[tagged >> 56 == p] for p in (2 * order, 2 * order + 1)))
        ratios = [log_ratio(own, unpacked(keys.as_py(), n.as_py())).astype(np.float32)
                  for keys, n in zip(asked.column("keys"), asked.column("n"))]
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"),
                         "ratios": pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in ratios], pa.binary())})

    def value(part: pa.Table, answers: pa.Table) -> pa.Table:
        w, word, found, at, order, used, cut = asked_keys(part)
        each = np.zeros(len(found))
        for bucket, ratios in zip(answers.column("bucket").to_pylist(), answers.column("ratios")):
            i = int(np.searchsorted(used, bucket))
            own = order[cut[i]:cut[i + 1]]
            each[own] = np.frombuffer(pa.decompress(ratios.as_py(), 4 * len(own), "zstd", asbytes=True), np.float32)
        ratio = np.bincount(word, weights=each[at], minlength=len(w.start))
        units = np.rint(np.maximum(ratio - MARGIN, 0) * UNIT).astype(np.int64)
        big = np.flatnonzero(units)
        return pa.table({"word": pa.array(W.signed(W.word_hashes(w)[big])), "value": pa.array(units[big]),
                         "slices": part.column("slices").take(pa.array(big))})

    asked = words.groupBy("block").applyInArrow(ask, "block int, bucket int, n int, keys binary")
    answers = (asked.groupBy("bucket").cogroup(counts.where("bucket >= 0").groupBy("bucket"))
               .applyInArrow(answer, "block int, bucket int, ratios binary"))
    found = words.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(value, "word long, value long, slices long")
    values = staged(found, "toxicity-values")
    discard(different, counts)
    for sent in (shared, upper):
        sent.destroy()
    return values


class Values:
    """Values of words: arrays of the most frequent ones, and for the ``rest`` a
    table with a Bloom filter of its words."""

    def __init__(self, values: DataFrame):
        top = values.orderBy(F.desc("slices"), "word").limit(FREQUENT).toPandas().sort_values("word")
        self.frequent = top["word"].to_numpy(np.int64), top["value"].to_numpy(np.int64)
        self.rest = None
        if len(top) == FREQUENT and values.count() > FREQUENT:
            known = values.sparkSession.createDataFrame(top[["word"]], "word long")
            self.rest = staged(values.join(F.broadcast(known), "word", "left_anti").select("word", "value"), "toxicity-rest")
            bits = bloom.filter_bits(self.rest.count())
            self.bitmaps, self.bits = staged(bloom.pages(bloom.cell_rows(self.rest, F.col("word"), bits)), "toxicity-bloom"), bits

    def extra(self, df: DataFrame, key: Column, text_col: str) -> DataFrame:
        """(row_key, extra): what the words of the ``rest`` add to each row."""
        frequent = df.sparkSession.sparkContext.broadcast(self.frequent[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end in W.byte_slices(batch.column("text"), SLICE_BYTES):
                    part = batch.slice(begin, end - begin)
                    w = W.split_words(part.column("text"), W.PLAIN)
                    word = W.signed(W.word_hashes(w))
                    new = ~np.isin(word, frequent.value)
                    word, row = word[new], w.row[new]
                    order = np.lexsort((word, row))
                    word, row = word[order], row[order]
                    first = np.ones(len(word), bool)
                    first[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
                    first = np.flatnonzero(first)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row_key").take(pa.array(row[first])), pa.array(word[first]),
                         pa.array(np.diff(np.append(first, len(word))).astype(np.int64))], names=["row_key", "word", "n"])

        pairs = df.select(key.alias("row_key"), F.col(text_col).alias("text")).mapInArrow(run, "row_key long, word long, n long")
        hits = bloom.with_hit(pairs, "word", self.bitmaps, self.bits).where("hit").drop("hit").join(self.rest, "word")
        # equal rows have one key: each of their words counts once
        return (hits.repartition("row_key").groupBy("row_key", "word").agg(F.max(F.col("n") * F.col("value")).alias("v"))
                .groupBy("row_key").agg(F.sum("v").alias("extra")))


def with_evidence(df: DataFrame, values: Values | None, id_col: str = "id", text_col: str = "text",
                  name: str = "evidence") -> DataFrame:
    """``df`` plus the evidence of each text: what its words' log-likelihood
    ratios have beyond the margin, for each of its words."""
    if values is None:
        return df.withColumn(name, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(values.frequent)    # at most FREQUENT words
    sums, n_words, key = (free_name(df, c) for c in ("units", "n_words", "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shared.value
        for batch in batches:
            for begin, end in W.byte_slices(batch.column(text_col), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                w = W.split_words(part.column(text_col), W.PLAIN)
                word = W.signed(W.word_hashes(w))
                total = np.zeros(part.num_rows, np.int64)
                if len(known) and len(word):
                    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    hit = np.flatnonzero(known[at] == word)
                    np.add.at(total, w.row[hit], value[at[hit]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total), pa.array(w.n_words.astype(np.int64))],
                                                 names=[*batch.schema.names, sums, n_words])

    fields = [T.StructField(c, T.LongType()) for c in (sums, n_words)]
    row_key = F.xxhash64(F.col(id_col), F.col(text_col))
    wide = df if values.rest is None else df.withColumn(key, row_key)
    rows = wide.mapInArrow(run, T.StructType(wide.schema.fields + fields))
    units = F.col(sums)
    if values.rest is not None:
        extra = staged(values.extra(df, row_key, text_col), "toxicity-extra")
        added = free_name(rows, "extra")
        rows = rows.join(extra.select(F.col("row_key").alias(key), F.col("extra").alias(added)), key, "left")
        units = units + F.coalesce(added, F.lit(0))
    return rows.select(*df.columns, (units / (F.greatest(F.col(n_words), F.lit(1)) * UNIT)).alias(name))


def logistic(x: np.ndarray, n: np.ndarray, hits: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve through binned labels, by damped
    Newton steps; targets are smoothed by one row of each class."""
    pos, neg = hits.sum(), (n - hits).sum()
    target = (hits * (pos + 1) / (pos + 2) + (n - hits) / (neg + 2)) / n
    slope, offset = 0.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((n * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        g = np.array([(n * (p - target) * x).sum(), (n * (p - target)).sum()])
        s = n * p * (1 - p) + 1e-9
        hess = np.array([[(s * x * x).sum() + 1e-9, (s * x).sum()], [(s * x).sum(), s.sum()]])
        step, size, old = np.linalg.solve(hess, g), 1.0, loss(slope, offset)
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > old:
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(size * step).max() < 1e-8 * max(1.0, abs(slope)):
            break
    return slope, offset


def log_evidence(name: str = "evidence") -> Column:
    return F.log(F.col(name) + F.lit(FLOOR))


def calibrate(rows: DataFrame) -> tuple[float, float]:
    """Logistic curve from (evidence, y) rows; a bounded histogram moves."""
    low, high = float(np.log(FLOOR)), float(np.log(100.0))
    width = (high - low) / BINS
    spot = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((log_evidence() - low) / width)))
    got = rows.groupBy(spot.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("hits")).toPandas()
    if not len(got):
        return 0.0, 0.0
    x = low + (got["bin"].to_numpy(float) + 0.5) * width
    return logistic(x, got["n"].to_numpy(float), got["hits"].to_numpy(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` plus ``evidence`` and ``score``: how likely a row's label is 1."""
    train = staged(train_texts(docs, labels, label, id_col, text_col), "toxicity-train")
    only_calibrates = F.xxhash64("id", F.lit("calibrate")) % CALIBRATE == 0
    model = train_model(train.where(~only_calibrates))
    values, slope, offset = None, 0.0, 0.0
    if model:
        found = word_values(docs, model, text_col)
        values = Values(found)
        discard(found)
        slope, offset = calibrate(with_evidence(train.where(only_calibrates), values))
    discard(train)
    evidence, score = (free_name(docs, c) for c in ADDED)
    z = log_evidence(evidence) * F.lit(float(slope)) + F.lit(float(offset))
    return with_evidence(docs, values, id_col, text_col, evidence).withColumn(score, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
