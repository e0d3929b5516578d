"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last ``WINDOW`` bytes has its top
bits zero, so equal passages of different documents fall into equal chunks
wherever they stand.  Every task keeps a table of the chunks it has met; a
new one is encoded once, from the parts between its stable places, of which
again each new one goes to the library once.  Memory is bounded, since the
tables are emptied at ``TABLE_BYTES`` of text.  A cut may fall anywhere, so the tokens
beside it are doubtful: each join is repaired by encoding a window of the text
around it, and the window is taken where its outer tokens are exactly those of
the two chunks; otherwise it is widened, in the end to the whole text.

Windows begin and end at *stable* places: a space after a character that is no
white space.  With this kind of vocabulary (byte-level splitting pattern, no
normaliser, no added token with a space or with stripping) a pretoken always
begins there and none before it looks further, so the ids of a text are those
of its parts between stable places.  Chunks with fewer than ``STABLE`` such
places are joined to the next before they are encoded.  Any other vocabulary
gets whole texts.  No row leaves its partition.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to the empty text; a text without spaces is one chunk at any length;
strings of special tokens inside a text become their ids, as in the library;
equal rows get equal ids; an empty table gives an empty result; input columns
stay as they are (added columns that clash get underscores in front).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vetta.llm.common import free_name
from vetta.llm.words import _powers, byte_slices, splitmix, text_buffer

WINDOW = 16                     # bytes of the rolling hash
CUT_BITS = 10                   # a cut every 1,024 bytes on average
STABLE = 4                      # stable places of a chunk at least
TABLE_BYTES = 32 << 20          # chunk text kept by a task
PARTS = 400_000                 # parts between stable places kept by a task
SLICE_BYTES = 1 << 20           # text handled at once in a task
ADDED = ("ids", "decoded")
BASE = 0x9E3779B97F4A7C15       # odd, so it has an inverse modulo 2^64


def _solid() -> np.ndarray:
    """Bytes that end no white space character: visible ASCII, and of the others
    those that are the last byte of no Unicode space."""
    t = np.zeros(256, dtype=bool)
    t[0x21:0x7F] = True
    t[0x80:] = True
    t[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    return t


SOLID = _solid()
STABLE_SPACE = re.compile(r"(?<=\S) ")      # parts of a text without their first space


def vocabulary(path: str) -> str:
    """The vocabulary file, read once on the driver and sent with the task (its
    size does not depend on the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(vocab: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(vocab)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splits_at_spaces(vocab: str) -> bool:
    """Whether a text may be encoded in parts between stable places."""
    v = json.loads(vocab)
    pre = v.get("pre_tokenizer") or {}
    return (v.get("normalizer") is None and v["model"]["type"] == "BPE" and not v["model"].get("dropout")
            and not v["model"].get("ignore_merges")
            and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in v.get("added_tokens", [])))


def token_sizes(vocab: str) -> np.ndarray:
    """UTF-8 bytes that each id stands for (one character of a token is one byte,
    an added token stands for its own text)."""
    v = json.loads(vocab)
    sizes = {i: len(t) for t, i in v["model"]["vocab"].items()}
    sizes.update({t["id"]: len(t["content"].encode()) for t in v.get("added_tokens", [])})
    out = np.zeros(max(sizes, default=-1) + 1, dtype=np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


class RollingHash:
    """Hashes of the ``WINDOW`` bytes before each place, from prefix sums of a
    polynomial (tables of powers grow with the longest text met)."""

    def __init__(self):
        self.table = splitmix(np.arange(1, 257, dtype=np.uint64))
        self.up = self.down = np.ones(1, np.uint64)

    def cuts(self, data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
        """Places inside the rows whose hash has ``bits`` zero bits on top, which
        begin a character and have a whole window of their row before them."""
        n = len(data)
        if n <= WINDOW:
            return np.zeros(0, np.int64)
        if len(self.up) < n:
            size = max(n, SLICE_BYTES)
            self.up, self.down = (_powers(b, size)
                                  for b in (BASE, pow(BASE, -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        h = splitmix((sums[WINDOW:-1] - sums[:n - WINDOW]) * self.down[:n - WINDOW])
        at = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + WINDOW
        row = np.searchsorted(offsets, at, "right") - 1
        return at[(data[at] & 0xC0 != 0x80) & (at - offsets[row] >= WINDOW)]


class Chunks:
    """Encodes texts from chunks met before."""

    def __init__(self, tok, sizes: np.ndarray, limit: int = TABLE_BYTES, bits: int = CUT_BITS):
        self.tok, self.sizes, self.limit, self.bits = tok, sizes, limit, bits
        self.hash = RollingHash()
        self.encoded = self.met = self.widened = self.whole = 0
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, tuple] = {}             # chunk: ids, stable places, ids before each
        self.heads: dict[str, int] = {}                 # first part of a chunk
        self.tails: dict[str, int] = {}                 # other parts, each after its space
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.held = 0

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
        """The chunks of each row, with ``STABLE`` stable places at least where the
        row has so many."""
        places = np.flatnonzero((data[1:] == 0x20) & SOLID[data[:-1]]) + 1
        cuts = self.hash.cuts(data, offsets, self.bits)
        upto = np.searchsorted(places, cuts).tolist()   # places before each cut
        after = np.searchsorted(places, cuts, "right").tolist()
        cuts = cuts.tolist()
        k, out, raw = 0, [], data.tobytes()
        ends = np.searchsorted(places, offsets).tolist()
        for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            last, seen, own = begin, int(np.searchsorted(places, begin, "right")), []
            while k < len(cuts) and cuts[k] < end:
                # the place at the first byte of a chunk is not one of its own
                if upto[k] - seen >= STABLE and ends[row + 1] - after[k] >= STABLE:
                    own.append(raw[last:cuts[k]])
                    last, seen = cuts[k], after[k]
                k += 1
            out.append([*own, raw[last:end]])
        return out

    def learn(self, parts: list[bytes]) -> None:
        """Encodes the chunks that the table lacks, each once, from their parts
        between stable places; a part that is new goes to the library."""
        new = [p for p in dict.fromkeys(parts) if p not in self.table]
        if not new:
            return
        split = [STABLE_SPACE.split(p.decode()) for p in new]
        heads, tails = self.heads, self.tails
        fresh = []
        for own in split:
            if own[0] not in heads:
                heads[own[0]] = len(self.ends) - 1 + len(fresh)
                fresh.append(own[0])
            for x in own[1:]:
                if x not in tails:
                    tails[x] = len(self.ends) - 1 + len(fresh)
                    fresh.append(" " + x)
        if fresh:
            found = [e.ids for e in self.tok.encode_batch_fast(fresh, add_special_tokens=False)]
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in found for i in ids), np.uint32)])
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.encoded += sum(map(len, fresh))
        which = np.fromiter((i for own in split for i in (heads[own[0]], *map(tails.__getitem__, own[1:]))), np.int64)
        begin, n = self.ends[which], self.ends[which + 1] - self.ends[which]
        upto = np.concatenate(([0], np.cumsum(n)))      # ids before each part
        ids = self.flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin, n)]
        bytes_upto = np.concatenate(([0], np.cumsum(self.sizes[ids])))[upto]
        a = 0
        for p, own in zip(new, split):
            b = a + len(own)
            self.table[p] = (ids[upto[a]:upto[b]], bytes_upto[a + 1:b] - bytes_upto[a], upto[a + 1:b] - upto[a])
            self.held += len(p)
            a = b

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a text buffer."""
        if self.held > self.limit or len(self.ends) > PARTS:
            self.clear()
        rows = self.chunks(data, offsets)
        self.learn([p for own in rows for p in own])
        self.learn([w for own in rows for a, b in zip(own[:-1], own[1:]) if (w := self.window(a, b, 1))])
        self.met += len(data)
        return [self.join(own) for own in rows]

    def window(self, a: bytes, b: bytes, overlap: int) -> bytes | None:
        """The text from ``overlap`` stable places before the last one of ``a`` to
        as many after the first one of ``b``; None if they have too few."""
        left, right = self.table[a][1], self.table[b][1]
        if len(left) <= overlap or len(right) <= overlap:
            return None
        return a[left[-1 - overlap]:] + b[:right[overlap]]

    def join(self, parts: list[bytes]) -> np.ndarray:
        """Ids of a text from those of its chunks, joins repaired."""
        out, begin = [], 0
        for a, b in zip(parts[:-1], parts[1:]):
            ids, _, at = self.table[a]
            repaired = self.repair(a, b)
            if repaired is None or begin > at[-1]:
                self.whole += 1
                return np.array(self.tok.encode(b"".join(parts).decode(), add_special_tokens=False).ids, dtype=np.uint32)
            out += [ids[begin:at[-1]], repaired]
            begin = self.table[b][2][0]
        return np.concatenate([*out, self.table[parts[-1]][0][begin:]])

    def repair(self, a: bytes, b: bytes) -> np.ndarray | None:
        """Ids from the last stable place of ``a`` to the first one of ``b``: those
        of a window whose outer ids are exactly those of ``a`` and ``b``."""
        (left, _, left_at), (right, _, right_at) = self.table[a], self.table[b]
        overlap = 1
        while (w := self.window(a, b, overlap)) is not None:
            self.learn([w])
            ids = self.table[w][0]
            head = left[left_at[-1 - overlap]:left_at[-1]]
            tail = right[right_at[0]:right_at[overlap]]
            if (len(ids) >= len(head) + len(tail) and np.array_equal(ids[:len(head)], head)
                    and np.array_equal(ids[len(ids) - len(tail):], tail)):
                return ids[len(head):len(ids) - len(tail)]
            self.widened += 1
            overlap *= 2
        return None


class WholeTexts:
    """The same interface for vocabularies that need whole texts."""

    def __init__(self, tok):
        self.tok = tok

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]


def encoder(vocab: str):
    tok = load(vocab)
    return Chunks(tok, token_sizes(vocab)) if splits_at_spaces(vocab) else WholeTexts(tok)


def encode_decode(df: DataFrame, vocab_path: str, text_col: str = "text", packed: bool = False) -> DataFrame:
    """``df`` plus ``ids`` (the library's ids of the text, without added special
    tokens; an array, or with ``packed`` their little-endian 32-bit bytes) and
    ``decoded`` (the library's text for those ids, special tokens kept)."""
    vocab = vocabulary(vocab_path)
    ids_name, decoded_name = (free_name(df, c) for c in ADDED)
    ids_type = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(df.schema.fields + [T.StructField(ids_name, ids_type), T.StructField(decoded_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        tok = load(vocab)
        for batch in batches:
            for begin, end in byte_slices(batch.column(text_col), SLICE_BYTES):
                rows = batch.slice(begin, end - begin)
                found = enc.encode(*text_buffer(rows.column(text_col)))
                decoded = tok.decode_batch([ids.tolist() for ids in found], skip_special_tokens=False)
                upto = np.cumsum([0] + [len(ids) for ids in found])
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                if packed:
                    ids = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((upto * 4).astype(np.int32)),
                                                                          pa.py_buffer(flat.astype("<u4"))])
                else:
                    ids = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, pa.array(decoded, pa.string())],
                                                 names=[*batch.schema.names, ids_name, decoded_name])

    return df.mapInArrow(run, schema)
