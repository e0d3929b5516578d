"""Substring deduplication by relative Lempel-Ziv parsing.

Documents lie in reference blocks of about ``BLOCK_BYTES`` of text (by a hash
of the id, so a hot source spreads).  Every block indexes its phrases of
``WINDOW`` words; a phrase is looked up in the indexes of all blocks at once,
as equal phrases meet in one bucket of the index and the bucket answers each
block with the smallest document that holds the phrase.  A document is then
factored greedily: a factor starts at a phrase that an earlier document holds
and grows word by word while the next phrase has the same source; the phrases
across the boundary of two factors are looked up like all others, so none is
missed there.  The words of all factors are the duplicate spans.

Two rounds keep the index small.  Equal phrases share an anchor, the smallest
of their ``SEED``-word seeds by hash; the first round moves anchors only (about
one in five words), and phrases whose anchor stands in one document cannot
repeat.  The second round moves the other phrases.  A block sends at most two
documents for each key, so a passage in a third of all documents costs a
bucket two entries for each block, not one for each document.

Phrases are compared by 64-bit hashes.

Defined cases: a null text has no words; texts shorter than a phrase lose
nothing; rows with the same id never remove words of each other; rows without
an id keep all words and are no source for others; an empty table gives an
empty result.  The operator returns, for each row, the id, the number of
words, the number removed, the kept words joined by one space, and the factors
(first word, number of words, source document).
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm import words as W

WINDOW = 13                     # words of a phrase
SEED = 5                        # words of an anchor
BLOCK_BYTES = 2 << 20           # text of a reference block
BLOCKS_PER_BUCKET = 4           # reference blocks for each index bucket
ENTRY = "bucket int, block int, keys binary, docs binary"
ANSWER = "block int, keys binary, docs binary"
RESULT = ("id long, n_words long, n_removed long, kept string, "
          "factors array<struct<first_word: int, n_words: int, source: long>>")


class Block:
    """Phrases and anchors of the documents of one block."""

    def __init__(self, rows: pa.Table, window: int, seed: int):
        known = pc.is_valid(rows.column("id")).to_numpy()
        self.ids = pc.fill_null(rows.column("id"), 0).to_numpy()        # a column with gaps would turn into doubles
        self.words = W.split_words(rows.column("text"))
        h = W.word_hashes(self.words)
        self.at = np.flatnonzero(W.window_valid(self.words, window))    # first words of phrases
        if len(self.at):
            self.at = self.at[known[self.words.row[self.at]]]
        self.doc = self.ids[self.words.row[self.at]]
        self.phrases = W.window_hashes(h, window)[self.at]
        seeds = W.window_hashes(h, seed, seed=3)
        self.anchors = np.full(len(self.at), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(window - seed + 1):
            np.minimum(self.anchors, seeds[self.at + j], out=self.anchors)


def _member(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among sorted keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def entries(block: int, keys: np.ndarray, docs: np.ndarray, buckets: int) -> pa.Table:
    """Index entries of a block: its different keys, each with its two smallest
    documents, packed by bucket."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new_key = np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new_pair = new_key.copy()
    new_pair[1:] |= docs[1:] != docs[:-1]
    keys, docs, new_key = keys[new_pair], docs[new_pair], new_key[new_pair]
    first = np.maximum.accumulate(np.where(new_key, np.arange(len(keys)), 0))
    two = np.arange(len(keys)) - first < 2
    keys, docs = keys[two], docs[two]
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, docs, bucket = keys[order], docs[order], bucket[order]
    used, begin = np.unique(bucket, return_index=True)
    ends = np.append(begin[1:], len(bucket))
    return pa.table({
        "bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
        "docs": pa.array([docs[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary())})


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    docs = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
    return (np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *docs]))


def answers(only_later: bool):
    """Index lookup in a bucket: for every block its keys that at least two
    documents hold, with the smallest such document; ``only_later`` leaves out
    blocks whose documents are not after it."""
    def run(bucket: pa.Table) -> pa.Table:
        keys, docs = _packed(bucket)
        sizes = np.array([len(x) // 8 for x in bucket.column("keys").to_pylist()])
        block = np.repeat(bucket.column("block").to_numpy(), sizes)
        order = np.argsort(keys, kind="stable")
        keys, docs, block = keys[order], docs[order], block[order]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        span = np.diff(np.append(begin, len(keys)))
        least = np.repeat(np.minimum.reduceat(docs, begin), span) if len(keys) else docs
        most = np.repeat(np.maximum.reduceat(docs, begin), span) if len(keys) else docs
        told = (docs > least) if only_later else (most > least)
        keys, least, block = keys[told], least[told], block[told]
        order = np.argsort(block, kind="stable")
        keys, least, block = keys[order], least[order], block[order]
        used, begin = np.unique(block, return_index=True)
        ends = np.append(begin[1:], len(block))
        return pa.table({
            "block": pa.array(used, pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
            "docs": pa.array([least[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary())})
    return run


def _answer(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys told to a block, sorted and different, with their documents."""
    keys, docs = _packed(table)
    keys, at = np.unique(keys, return_index=True)
    return keys, docs[at]


def factor(doc: np.ndarray, at: np.ndarray, row: np.ndarray, source: np.ndarray, repeated: np.ndarray) -> tuple:
    """Greedy factors: maximal runs of repeated phrases with one source, as
    (row, first word, number of phrases, source)."""
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.ones(len(hit), bool)
    new[1:] = (at[hit[1:]] != at[hit[:-1]] + 1) | (source[hit[1:]] != source[hit[:-1]]) | (row[hit[1:]] != row[hit[:-1]])
    begin = np.flatnonzero(new)
    return row[hit[begin]], at[hit[begin]], np.diff(np.append(begin, len(hit))), source[hit[begin]]


def parse(rows: pa.Table, told: pa.Table, window: int, seed: int) -> pa.Table:
    """Factor the documents of a block and cut the factors out."""
    block = Block(rows, window, seed)
    keys, sources = _answer(told)
    known, where = _member(block.phrases, keys)
    source = sources[where] if len(keys) else np.zeros(len(where), np.int64)
    w = block.words
    repeated = known & (source < block.doc)
    row, first, phrases, source = factor(block.doc, block.at, w.row[block.at], source, repeated)
    edges = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + phrases + window - 1, -1)
    keep = np.cumsum(edges[:-1]) == 0
    removed = np.bincount(w.row[~keep], minlength=rows.num_rows)
    kept = []
    for r, text in enumerate(rows.column("text").to_pylist()):
        parts = (text or "").encode().split()           # bytes: exactly the six ASCII spaces
        kept.append(b" ".join(compress(parts, keep[w.first[r]:w.first[r + 1]]) if removed[r] else parts).decode())
    ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
    spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(first - w.first[row], pa.int32()), pa.array(phrases + window - 1, pa.int32()),
         pa.array(source, pa.int64())], names=["first_word", "n_words", "source"]))
    return pa.table({"id": rows.column("id"), "n_words": pa.array(w.n_words, pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "factors": spans})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept, factors) of every row; see the module."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    buckets = max(1, math.ceil(blocks / BLOCKS_PER_BUCKET))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                     F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int").alias("block"))
    by_block = docs.groupBy("block")

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows, window, seed)
        return entries(key[0].as_py(), block.anchors, block.doc, buckets)

    def phrases(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(rows, window, seed)
        shared, _ = _member(block.anchors, _answer(told)[0])
        return entries(key[0].as_py(), block.phrases[shared], block.doc[shared], buckets)

    def parsed(rows: pa.Table, told: pa.Table) -> pa.Table:
        return parse(rows, told, window, seed)

    shared = by_block.applyInArrow(anchors, ENTRY).groupBy("bucket").applyInArrow(answers(False), ANSWER)
    repeated = (by_block.cogroup(shared.groupBy("block")).applyInArrow(phrases, ENTRY)
                .groupBy("bucket").applyInArrow(answers(True), ANSWER))
    return by_block.cogroup(repeated.groupBy("block")).applyInArrow(parsed, RESULT)
