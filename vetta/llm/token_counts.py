"""Token counts by overlap resynchronisation.

Texts of up to ``HUGE_CHARS`` characters go to the library whole.  A longer one
is encoded in overlapping chunks; two neighbouring chunks are spliced at a
boundary that both encodings have inside the overlap and that is proven
stable: the next piece begins with the whitespace marker, the character before
is no space, and no piece of the vocabulary holds a marker after another
character, so no encoding of any surrounding text can have a piece across it.
Where an overlap holds no such boundary it is doubled, in the end to the whole
text, so the count always equals that of the whole text; for a model without
the property every text is encoded whole.

Defined cases: a null text counts as empty and has 0 tokens; a text without
spaces is encoded whole; equal rows get equal counts; an empty table gives an
empty result; input columns stay as they are (an added column that clashes
gets underscores in front).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vetta.llm.common import free_name
from vetta.llm.pieces import MARK, SLICE_BYTES, load, model_bytes, splits_at_marks
from vetta.llm.words import byte_slices

HUGE_CHARS = 8192               # longer texts are encoded in chunks
CHUNK_CHARS = 4096
OVERLAP_CHARS = 256             # first try; doubled where it does not align
ADDED = "n_tokens"


class Resync:
    """Counts the tokens of long texts from overlapping chunks."""

    def __init__(self, sp, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.sp, self.chunk, self.overlap = sp, chunk, overlap
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.closed = np.array([not p.endswith(MARK) for p in pieces])
        # characters a piece stands for; of the bytes of a character only the first counts
        self.chars = np.array([(0 if 0x80 <= int(p[3:5], 16) < 0xC0 else 1) if sp.is_byte(i) else len(p)
                               for i, p in enumerate(pieces)])
        self.widened = 0

    def boundaries(self, chunk: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Stable boundaries of a chunk's encoding: places in the chunk, tokens
        before each, and all tokens; None where places cannot be told."""
        ids = np.array(self.sp.encode(chunk, num_threads=1), dtype=np.int64)
        upto = np.cumsum(self.chars[ids])
        if not len(ids) or upto[-1] != len(chunk) + 1:      # one more: the dummy prefix
            return None
        at = np.flatnonzero(self.marked[ids[1:]] & self.closed[ids[:-1]]) + 1
        return upto[at - 1] - 1, at, len(ids)

    def count(self, text: str) -> int:
        text = text.replace(MARK, " ")
        total, begin, left = 0, 0, None             # left: the chunk's stable boundaries
        overlap = self.overlap
        end = min(len(text), self.chunk)
        left = self.boundaries(text[begin:end])
        done = 0                                    # tokens of this chunk already counted
        while left is not None and end < len(text):
            start = max(begin, end - overlap)
            to = min(len(text), max(start + self.chunk, end + overlap))
            right = self.boundaries(text[start:to])
            if right is None:
                break
            here = left[0] + begin
            there = right[0] + start
            common, i, j = np.intersect1d(here, there, return_indices=True)
            ok = np.flatnonzero((common > start) & (common < end) & (left[1][i] >= done))
            if not len(ok):                         # no proven boundary: widen both ways
                self.widened += 1
                overlap *= 2
                if start == begin:
                    end = min(len(text), end + overlap)
                    left = self.boundaries(text[begin:end])
                continue
            k = ok[0]
            total += int(left[1][i[k]]) - done
            done = int(right[1][j[k]])
            begin, end, left, overlap = start, to, right, self.overlap
        if left is None or end < len(text):
            return len(self.sp.encode(text, num_threads=1))
        return total + left[2] - done


def token_counts(df: DataFrame, model_path: str, text_col: str = "text", huge: int = HUGE_CHARS,
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``df`` plus ``n_tokens``, the number of the library's ids of each text."""
    model = model_bytes(model_path)
    name = free_name(df, ADDED)
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        resync = Resync(sp, chunk, overlap) if splits_at_marks(sp) else None
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for begin, end in byte_slices(batch.column(text_col), SLICE_BYTES):
                texts = [t or "" for t in batch.column(text_col).slice(begin, end - begin).to_pylist()]
                short = [k for k, t in enumerate(texts) if resync is None or len(t) <= huge]
                own = counts[begin:end]
                own[short] = [len(ids) for ids in sp.encode([texts[k] for k in short], num_threads=1)] if short else []
                for k, t in enumerate(texts):
                    if resync is not None and len(t) > huge:
                        own[k] = resync.count(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
