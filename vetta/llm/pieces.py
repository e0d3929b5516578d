"""SentencePiece encoding and decoding through a distinct-chunk table.

When no piece of a vocabulary holds a whitespace marker after another
character, no merge crosses the place where a run of markers begins, so a text
is the sequence of its marked words (a run of spaces and what follows up to
the next space) and each distinct marked word has one segmentation.  Every
task keeps a table of the marked words it has met, segments each new one once
with the library, and joins the ids back by position with array indexing; the
table is emptied at ``TABLE_WORDS`` words, so memory is bounded.  No row leaves
its partition.  For a model without that property, or with a normaliser that
changes text, whole texts go to the library.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to the empty text; equal rows get equal ids; an empty table gives an
empty result; input columns stay as they are (added columns that clash get
underscores in front).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vetta.llm.common import free_name
from vetta.llm.words import byte_slices

MARK = "▁"                 # the library's visible space
TABLE_WORDS = 100_000           # marked words kept by a task
SLICE_BYTES = 1 << 20           # text handled at once in a task
ADDED = ("ids", "decoded")
PROBE = " a  b　ﬁ é "    # text that normalisers change


def model_bytes(path: str) -> bytes:
    """The vocabulary file, read once on the driver and sent with the task
    (its size does not depend on the data)."""
    with open(path, "rb") as f:
        return f.read()


def load(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_marks(sp) -> bool:
    """Whether marked words can be segmented one by one."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return (not any(MARK in p.lstrip(MARK) for p in pieces)
            and sp.normalize(PROBE) == MARK + PROBE.replace(" ", MARK))


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker (which the
    library puts back as its dummy prefix); '' is a lone marker."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    words = text.split(" ")
    if all(words):
        return words
    return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]


class ChunkTable:
    """Segmentations of the marked words met so far."""

    def __init__(self, sp, limit: int = TABLE_WORDS):
        self.sp, self.limit = sp, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.parts = [np.array([self.sp.piece_to_id(MARK)], dtype=np.int32)]
        self.sizes = [np.ones(1, dtype=np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets of each text."""
        if len(self.index) > self.limit:
            self.clear()
        split = [marked_words(t) for t in texts]
        index = self.index
        new = list(dict.fromkeys(w for words in split for w in words if w not in index))
        if new:
            found = self.sp.encode(new, num_threads=1)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            self.parts.append(np.fromiter((i for ids in found for i in ids), np.int32))
        self.sizes, self.parts = [np.concatenate(self.sizes)], [np.concatenate(self.parts)]
        sizes, flat = self.sizes[0], self.parts[0]
        begins = np.cumsum(sizes) - sizes
        at = np.fromiter((index[w] for words in split for w in words), np.int64)
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - begins[at], n)]
        words_upto = np.cumsum([0] + [len(w) for w in split])
        return ids, np.concatenate(([0], ends))[words_upto]


class WholeTexts:
    """The same interface for models whose pieces may cross markers."""

    def __init__(self, sp):
        self.sp = sp

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.sp.encode(texts, num_threads=1) if texts else []
        return (np.fromiter((i for ids in found for i in ids), np.int32),
                np.cumsum([0] + [len(ids) for ids in found]))


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ``ids`` (the library's ids of the text, without begin or end
    ids) and ``decoded`` (the library's text for those ids)."""
    model = model_bytes(model_path)
    ids_name, decoded_name = (free_name(df, c) for c in ADDED)
    schema = T.StructType(df.schema.fields + [T.StructField(ids_name, T.ArrayType(T.IntegerType(), False)),
                                              T.StructField(decoded_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        encoder = ChunkTable(sp) if splits_at_marks(sp) else WholeTexts(sp)
        for batch in batches:
            for begin, end in byte_slices(batch.column(text_col), SLICE_BYTES):
                rows = batch.slice(begin, end - begin)
                ids, offsets = encoder.encode([t or "" for t in rows.column(text_col).to_pylist()])
                decoded = [sp.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(offsets[:-1], offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(decoded, pa.string())],
                                                 names=[*batch.schema.names, ids_name, decoded_name])

    return df.mapInArrow(run, schema)
