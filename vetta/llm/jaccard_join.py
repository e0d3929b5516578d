"""Near-duplicates by a Jaccard metric-space join of word shingles.

One minus the Jaccard index is a metric on shingle sets; two documents link at
a distance of at most 1 - ``PERCENT`` / 100.  Pivots drawn at random have
distance 1 to nearly every document, so regions open where documents meet: the
sets with one shingle among the rarest quarter of each (linked sets share such
a shingle), cut where sorted set sizes jump too far for a link.  In every
region

* a pivot is drawn; signatures (a few bits for each shingle, whose differing bits
  are never more than the differing shingles) tell most members that are too far
  from it, with a lower bound of their distance, and only for the others sets
  move and exact distances are computed; the members within the threshold form
  its ball and link with it;
* by the triangle inequality a set at distance d from the pivot links only
  with sets whose distance lies in the window d - threshold to d + threshold;
  members outside the ball go on to the next round, and of the ball only
  boundary sets in the window of the nearest such member go with them.

In the next round the sets of all regions with one pivot form the region of
that pivot.  A region whose members are connected by now is done; in the others
the members outside the largest component are compared with all members, in the
window and between components only, in blocks of bounded size: by signatures, and
exactly where these allow a link.  A block that would emit more than a few pairs
for each of its rows is joined whole, through the shingles its sets hold.  No link
between different components is missed and no group emits all its pairs.
The rarity order comes
from a count sketch over all documents that grows with them up to a bound (any
order gives right results; a shingle's count is never underestimated, so a
bucket of the shingle index holds at most ``HEAVY`` sets and a few average cells
for each of its shingles, and more frequent ones take part as plain rows that
no task collects).

Equal sets are one node (by 64-bit set hashes; shingles by 64-bit hashes).
Components come from the links by label shrinking.

Defined cases: texts without words (null, empty, blank) have no shingles and
are components of their own; texts with fewer words than a shingle have their
whole sequence as the only one; equal rows join one component; rows with one
id and different texts are judged by their texts; rows with a null id link as
others do, but a null id never names a component that has another; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetta.llm import bloom
from vetta.llm import words as W
from vetta.llm.common import discard, staged
from vetta.llm.components import components

SHINGLE = 5                     # words of a shingle
PERCENT = 75                    # least Jaccard index of a link, in percent
SKETCH_BITS = 22, 24            # cells of the count sketch, least and most: 32 MB broadcast
PAGE_CELLS = 1 << 16            # sketch cells in one row
HEAVY = 2000                    # counts from which a shingle skips the buckets
BUCKETS = 16                    # buckets of the shingle index, where each has
BUCKET_BYTES = 8 << 20, 32 << 20    # at least and at most so much text
SIGNATURE_BITS = 2              # bits of a signature for each shingle, at least
LIGHT = 4                       # pairs for each row of a block that are looked at one by one
GRID_MEMBERS, GRID_OUTSIDE = 4096, 1024     # members and members outside in a block,
GRID_KEYS = 1 << 21             # and shingles of the former; of the latter a quarter
SLICE_BYTES = 2 << 20


class Sets:
    """Shingle sets of a text column: set r is ``keys[first[r]:first[r + 1]]``,
    sorted; ``node`` is a hash of the whole set."""

    def __init__(self, col, size: int = SHINGLE):
        w = W.split_words(col, W.LOWER)
        h = W.word_hashes(w)
        at = np.flatnonzero(W.window_valid(w, size))
        keys, rows = [W.window_hashes(h, size)[at]], [w.row[at]]
        for n in range(1, size):                # whole sequences of short texts
            short = np.flatnonzero(w.n_words == n)
            keys.append(W.window_hashes(h, n, seed=100 + n)[w.first[short]] if len(short) else np.zeros(0, np.uint64))
            rows.append(short)
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        self.keys, self.rows = keys[new], rows[new]
        self.first = np.searchsorted(self.rows, np.arange(len(col) + 1))
        self.n = np.diff(self.first)
        sums = np.zeros(len(self.keys) + 1, np.uint64)
        np.cumsum(W.splitmix(self.keys ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        self.node = W.signed(W.splitmix(total + self.n.astype(np.uint64)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in W.byte_slices(batch.column("text"), SLICE_BYTES):
            yield batch.slice(begin, end - begin)


def nodes_of(docs: DataFrame) -> DataFrame:
    """(id, row_key, n, node) of every (id, text, row_key) row; node is null
    without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = Sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("row_key"), pa.array(sets.n, pa.int64()), pa.array(sets.node, mask=sets.n == 0)],
                names=["id", "row_key", "n", "node"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, row_key long, n long, node long")


def sketch_bits(size: int) -> int:
    """As many cells as ``size`` bytes of text have words, within the bounds."""
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], math.ceil(math.log2(max(1, size / 6)))))


def _cell(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def count_sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """Shingle counts by cell over all documents, cut off at 65,535: 2 ** bits
    numbers."""
    pages = (1 << bits) // PAGE_CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for part in _slices(batches):
            cells, n = np.unique(_cell(Sets(part.column("text")).keys, bits), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + n, 65535)
        used = np.flatnonzero(counts.reshape(pages, -1).any(axis=1))
        cut = np.minimum(counts, 65535).astype(np.uint16).reshape(pages, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([pa.compress(cut[p].tobytes(), "zstd", asbytes=True) for p in used], pa.binary())],
            names=["page", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PAGE_CELLS, dtype=np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(pa.decompress(x, PAGE_CELLS * 2, "zstd", asbytes=True), np.uint16)
        return pa.table({"page": table.column("page")[:1],
                         "counts": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())})

    schema = "page int, counts binary"
    out = np.zeros((pages, PAGE_CELLS), dtype=np.uint16)
    for row in docs.mapInArrow(count, schema).groupBy("page").applyInArrow(add, schema).toLocalIterator():
        out[row.page] = np.frombuffer(row.counts, np.uint16)
    return out.ravel()


def postings(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Rare shingles of every set with its node and size, packed by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    bits, heavy = len(counts).bit_length() - 1, HEAVY + int(4 * counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = Sets(part.column("text"))
            rank = shared.value[_cell(sets.keys, bits)]
            order = np.lexsort((sets.keys, rank, sets.rows))
            place = np.arange(len(order)) - sets.first[sets.rows]
            need = -(-sets.n * PERCENT // 100)          # least shingles in common
            once = np.zeros(len(sets.n), bool)
            once[np.unique(sets.node, return_index=True)[1]] = True
            rare = (place < (sets.n - need + 1)[sets.rows]) & once[sets.rows]
            keys, rows, rank = sets.keys[order][rare], sets.rows[rare], rank[order][rare]
            node, n = sets.node[rows], sets.n[rows].astype(np.int32)
            bucket = np.where(rank >= min(heavy, 65535), buckets, (keys % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            keys, node, n, bucket = keys[order], node[order], n[order], bucket[order]
            used, begin = np.unique(bucket, return_index=True)
            cuts = list(zip(begin, np.append(begin[1:], len(bucket))))
            # half a key is enough within a bucket: what meets by chance is told apart later
            keys = (keys >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
                                               for x in (keys, node, n))], names=["bucket", "keys", "nodes", "sizes"])

    return docs.mapInArrow(run, "bucket int, keys binary, nodes binary, sizes binary")


def meeting_places(packed: DataFrame, buckets: int) -> DataFrame:
    """Sets that share a rare shingle, cut where sorted sizes are too far apart for
    a link: a row for each region with its members (``nodes``, ``sizes``) and what
    tells them from others (``size``, ``low``, ``high``, ``mark``), those with the same
    members once in a bucket.  Members of frequent shingles are rows (region, node, n)."""
    def column(rows, name: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in rows.column(name).to_pylist())])

    def unpacked(rows) -> tuple[np.ndarray, ...]:
        held = [len(x) // 4 for x in rows.column("keys").to_pylist()]
        bucket = np.repeat(rows.column("bucket").to_numpy().astype(np.uint64), held)
        keys = (column(rows, "keys", np.uint32).astype(np.uint64) << np.uint64(32)) | bucket
        return keys, column(rows, "nodes", np.int64), column(rows, "sizes", np.int32)

    def run(rows: pa.Table) -> pa.Table:
        keys, node, n = unpacked(rows)
        order = np.lexsort((node, n, keys))
        keys, node, n = keys[order], node[order], n[order]
        again = np.ones(len(keys), bool)
        again[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])
        keys, node, n = keys[again], node[again], n[again].astype(np.int64)
        begins = np.ones(len(keys), bool)
        begins[1:] = (keys[1:] != keys[:-1]) | (100 * n[:-1] < PERCENT * n[1:])
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(keys))[:len(first)]
        region = W.signed(W.splitmix(keys[first] + n[first].astype(np.uint64)))
        size, low, high, mark = end - first, *(np.zeros(0, np.int64),) * 3
        if len(first):
            low, high = np.minimum.reduceat(node, first), np.maximum.reduceat(node, first)
            mark = W.signed(np.add.reduceat(W.splitmix(node.view(np.uint64)), first))
        several = np.flatnonzero(size > 1)
        tags = np.stack([size, low, high, mark], axis=1)[several]
        at = several[np.unique(tags, axis=0, return_index=True)[1]]
        n = n.astype(np.int32)
        return pa.table({
            "region": pa.array(region[at]), "node": pa.nulls(len(at), pa.int64()), "n": pa.nulls(len(at), pa.int64()),
            "size": pa.array(size[at], pa.int64()), "low": pa.array(low[at]), "high": pa.array(high[at]), "mark": pa.array(mark[at]),
            "nodes": pa.array([node[first[i]:end[i]].tobytes() for i in at], pa.binary()),
            "sizes": pa.array([n[first[i]:end[i]].tobytes() for i in at], pa.binary())})

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, node, n = unpacked(batch.slice(r, 1))
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys)), pa.array(node), pa.array(n, pa.int64())],
                                                 names=["region", "node", "n"])

    rows = "region long, node long, n long"
    whole = f"{rows}, size long, low long, high long, mark long, nodes binary, sizes binary"
    return (packed.where(F.col("bucket") < buckets).groupBy("bucket").applyInArrow(run, whole)
            .unionByName(packed.where(F.col("bucket") >= buckets).mapInArrow(passed, rows).distinct(), allowMissingColumns=True))


def merged(places: DataFrame) -> DataFrame:
    """(region, node, n): of staged meeting places those with the same members once,
    single members left out; the places are deleted.  Regions that lie in one row are
    told apart without their members, and only those that stay are unpacked."""
    whole, loose = places.where("size is not null"), places.where("size is null").select("region", "node", "n")
    region = loose.groupBy("region").agg(
        F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.sum(F.shiftright(F.xxhash64("node"), 16)).alias("mark")).where("size > 1")
    region = region.unionByName(whole.select(*region.columns))
    once = region.groupBy("size", "low", "high", "mark").agg(F.min("region").alias("region"))
    once = staged(once.select("region"), "merged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("nodes", np.int64), ("sizes", np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("region").to_numpy(), batch.column("size").to_numpy())), pa.array(node),
                 pa.array(n, pa.int64())], names=["region", "node", "n"])

    bits = bloom.filter_bits(once.count())
    bitmaps = bloom.pages(bloom.cell_rows(once, F.col("region"), bits))
    stay = bloom.with_hit(whole.select("region", "size", "nodes", "sizes"), "region", bitmaps, bits).where("hit").drop("hit")
    stay = stay.join(once, "region", "left_semi")
    kept = staged(stay.mapInArrow(run, "region long, node long, n long")
                  .unionByName(loose.join(once, "region", "left_semi")), "regions")
    discard(once, places)
    return kept


def row_key(id_col: str, text_col: str) -> Column:
    """A key of the (id, text) rows, also of those without an id."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def signature(keys: np.ndarray) -> np.ndarray:
    """Parity of the keys in each of a power of two of cells, as bytes.  Two sets
    differ in at least as many shingles as their signatures in bits."""
    cells = 1 << max(6, (SIGNATURE_BITS * len(keys) - 1).bit_length())
    at = (keys & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8))


def folded(marks: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as ones of ``size`` words: cells are the
    last bits of a key, so halves lie upon each other."""
    while marks.shape[-1] > size:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signatures, folded to the smaller size."""
    size = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(axis=-1, dtype=np.int64)


def may_link(nx, ny, bits):
    """False where sets of these sizes whose signatures differ in ``bits`` cannot link."""
    most = (nx + ny - bits) // 2                # shingles in common
    return (100 * most >= PERCENT * (nx + ny - most)) & (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny))


def rows_of(docs: DataFrame, members: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose key is in ``chosen``: those told where they lie, and the
    few that are looked up.  ``members`` holds the keys of all rows, so those that a
    filter of the chosen ones lets through by mistake are known, and rows outside a
    second filter, of these, are right."""
    def pages(keys: DataFrame, bits: int) -> DataFrame:
        return staged(bloom.pages(bloom.cell_rows(keys, F.col("row_key"), bits)), "bits")

    keys = chosen.select("row_key")
    bits = bloom.filter_bits(chosen.count())
    first = pages(keys, bits)
    wrong = bloom.with_hit(members.select("row_key"), "row_key", first, bits).where("hit").select("row_key")
    wrong = staged(wrong.join(keys, "row_key", "left_anti").distinct(), "wrong")
    wrong_bits = bloom.filter_bits(wrong.count())
    second = pages(wrong, wrong_bits)
    discard(wrong)
    rows = bloom.with_hit(docs, "row_key", first, bits).where("hit").drop("hit")
    rows = bloom.with_hit(rows, "row_key", second, wrong_bits)
    return rows.where(~F.col("hit")).drop("hit"), rows.where("hit").drop("hit").join(keys, "row_key", "left_semi")


def sets_of(docs: DataFrame, members: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, keys, bits) of the wanted nodes, from one document of each: the set and
    its ``signature``.  Hardly a text moves (see ``rows_of``)."""
    chosen = staged(names.join(wanted, "node", "left_semi").select("node", "row_key"), "chosen")
    n = chosen.count()
    told, looked_up = rows_of(docs, members, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _slices(batches):
            sets = Sets(part.column("text"))
            new = [r for r in np.unique(sets.node, return_index=True)[1] if sets.n[r] and int(sets.node[r]) not in seen]
            seen.update(sets.node[new].tolist())
            keys = [sets.keys[sets.first[r]:sets.first[r + 1]] for r in new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.node[new]), pa.array([k.tobytes() for k in keys], pa.binary()),
                 pa.array([signature(k).tobytes() for k in keys], pa.binary())], names=["node", "keys", "bits"])

    texts = told.select("text").unionByName(looked_up.select("text"))
    sets = staged(texts.mapInArrow(run, "node long, keys binary, bits binary"), "keys")
    discard(chosen)
    if sets.count() > n:                        # equal rows, or rows whose keys collide
        repeated, sets = sets, staged(sets.dropDuplicates(["node"]), "keys")
        discard(repeated)
    return sets


def _views(col) -> list[np.ndarray]:
    """Packed sets of a binary column, without a copy."""
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[a:b].view(np.uint64) for a, b in zip(at[:-1], at[1:])]


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of some nodes (few others): the rest stays out of the shuffle."""
    wanted = staged(nodes.distinct(), "wanted")
    bits = bloom.filter_bits(wanted.count())
    bitmaps = staged(bloom.pages(bloom.cell_rows(wanted, F.col("node"), bits)), "wanted-bits")
    discard(wanted)
    return bloom.with_hit(sets, "node", bitmaps, bits).where("hit").drop("hit")


def apart(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, least) of the pairs (a, b, na, nb): a lower bound of the distance where
    signatures rule a link out, null where they do not."""
    def side(c: str) -> DataFrame:
        return sets.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _views(batch.column("bits_a")), _views(batch.column("bits_b"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            bits = np.array([differing(p, q) for p, q in zip(x, y)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(2 * bits / (na + nb + bits), mask=may_link(na, nb, bits))],
                names=["a", "b", "least"])

    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    return full.mapInArrow(run, "a long, b long, least double")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, na, nb) of the pairs (a, b), exactly."""
    def side(c: str) -> DataFrame:
        return only(sets.select("node", "keys"), pairs.select(F.col(c).alias("node"))).select(
            F.col("node").alias(c), F.col("keys").alias(f"k{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _views(batch.column("ka")), _views(batch.column("kb"))
            common = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()),
                 pa.array([len(p) for p in x], pa.int64()), pa.array([len(q) for q in y], pa.int64())],
                names=["a", "b", "common", "na", "nb"])

    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "kb")
    return full.mapInArrow(run, "a long, b long, common long, na long, nb long")


def _linked() -> Column:
    return 100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))


def _near_sizes(x: str, y: str) -> Column:
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _distance() -> Column:
    return 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))


def measured(rows: DataFrame) -> DataFrame:
    """Each region's members, the shingles they hold (``held``), the members
    outside the largest component and their shingles (``others``, ``other_held``), its
    label (``top``) and the pairs of members between different components (``open``)."""
    parts = rows.groupBy("region", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    n, squares = F.sum("c"), F.sum(F.col("c") * F.col("c"))
    largest = F.max(F.struct("c", "label", "s"))
    return parts.groupBy("region").agg(n.alias("size"), F.sum("s").alias("held"), largest["label"].alias("top"),
                                       (n - largest["c"]).alias("others"), (F.sum("s") - largest["s"]).alias("other_held"),
                                       ((n * n - squares) / 2).cast("long").alias("open"))


def grid_links(big: DataFrame, sets: DataFrame, reach: float) -> DataFrame:
    """Links (a, b) of regions with many open pairs: members outside the largest
    component and all members lie in blocks, and a task compares one block of each
    by signatures.  The few pairs that may link are measured one by one; blocks with
    many of them are joined by ``block_links``.  The links are staged."""
    def blocks(rows: str, held: str, size: int, keys: int) -> Column:
        return F.ceil(F.greatest(F.col(rows) / size, F.col(held) / keys)).cast("int")

    def block(count: Column, name: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(name)), count).cast("int")

    many = blocks("size", "held", GRID_MEMBERS, GRID_KEYS)
    few = blocks("others", "other_held", GRID_OUTSIDE, GRID_KEYS // 4)
    cols = ["region", "node", "n", "d", "label", "top"]
    members = big.select(*cols, block(many, "member").alias("m"), F.explode(F.sequence(F.lit(0), few - 1)).alias("o"),
                         F.lit(False).alias("asks"))
    outside = big.where("label <> top").select(*cols, block(few, "outside").alias("o"),
                                               F.explode(F.sequence(F.lit(0), many - 1)).alias("m"), F.lit(True).alias("asks"))
    cells = members.unionByName(outside)

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        region, m, o, node, label, n = (cell.column(c).to_numpy() for c in ("region", "m", "o", "node", "label", "n"))
        d = cell.column("d").to_numpy().astype(float)
        asks = cell.column("asks").to_numpy(zero_copy_only=False)
        bits = _views(cell.column("bits").chunk(0) if cell.num_rows else pa.array([], pa.binary()))
        words = np.array([len(x) for x in bits], np.int64)
        classes = [(np.flatnonzero(~asks & (words == size)), size) for size in np.unique(words[~asks])]
        classes = [(rows, size, np.stack([bits[r] for r in rows])) for rows, size in classes]
        pairs, found = [], 0
        for i in np.flatnonzero(asks):
            for rows, size, marks in classes:
                if not words[i] // 2 <= size <= words[i] * 2:       # too far apart in size
                    continue
                near = may_link(n[i], n[rows], differing(marks, bits[i]))
                near &= (label[rows] != label[i]) & ~(np.abs(d[rows] - d[i]) > reach)
                pairs.append((np.full(near.sum(), node[i]), node[rows[near]]))
                found += len(pairs[-1][0])
            if found > LIGHT * len(node):
                return pa.table({"region": region[:1], "m": m[:1], "o": o[:1], "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())})
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs) if pairs else ((), ())))
        return pa.table({"region": pa.array(np.resize(region, len(a))), "m": pa.array(np.resize(m, len(a)), pa.int32()),
                         "o": pa.array(np.resize(o, len(a)), pa.int32()), "a": pa.array(a), "b": pa.array(b)})

    marked = cells.join(sets.select("node", "bits"), "node")
    near = staged(marked.groupBy("region", "m", "o").applyInArrow(run, "region long, m int, o int, a long, b long"), "near")
    pairs = staged(near.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = distances(pairs, sets).where(_linked()).select("a", "b")
    heavy = near.where("a is null").select("region", "m", "o")
    if not heavy.isEmpty():
        links = links.union(block_links(cells.join(heavy, ["region", "m", "o"], "left_semi"), sets, reach))
    links = staged(links, "grid")
    discard(near, pairs)
    return links


def block_links(cells: DataFrame, sets: DataFrame, reach: float) -> DataFrame:
    """Links (a, b) of whole blocks through the shingles they hold, so no pair is
    emitted that does not link."""
    cells = cells.join(only(sets.select("node", "keys"), cells.select("node")), "node")

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        node, label, n = (cell.column(c).to_numpy() for c in ("node", "label", "n"))
        d = cell.column("d").to_numpy().astype(float)
        asks = cell.column("asks").to_numpy(zero_copy_only=False)
        keys = _views(cell.column("keys").chunk(0) if cell.num_rows else pa.array([], pa.binary()))
        member, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(member) and len(asking):
            flat = np.concatenate([keys[i] for i in member])
            owner = np.repeat(np.arange(len(member)), [len(keys[i]) for i in member])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in asking:
                begin, end = np.searchsorted(flat, keys[i], "left"), np.searchsorted(flat, keys[i], "right")
                count = end - begin
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin, count)
                common = np.bincount(owner[at], minlength=len(member))
                near = 100 * common >= PERCENT * (n[i] + n[member] - common)
                near &= (label[member] != label[i]) & ~(np.abs(d[member] - d[i]) > reach)
                # one member of each other component is enough
                found = member[near]
                found = found[np.unique(label[found], return_index=True)[1]]
                links.append((np.full(len(found), node[i]), node[found]))
        a, b = (np.concatenate(x) for x in zip(*links))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("region", "m", "o").applyInArrow(run, "a long, b long")


def recursive_links(regions: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): links enough to connect what is linked in any region.  The staged
    regions and sets are deleted."""
    reach = 1 - PERCENT / 100 + 1e-9            # threshold, and room for rounding
    plain, regions = regions, staged(regions.join(names.select("node", F.col("name").alias("label")), "node"), "regions")
    discard(plain)

    # balls: the smallest node of each region is its pivot, so the regions of
    # one group of copies agree on it and each distance is computed once
    pivots = staged(regions.groupBy("region").agg(F.min(F.struct("node", "n")).alias("p"))
                    .select("region", F.col("p.node").alias("p"), F.col("p.n").alias("np")), "pivots")
    asked = regions.join(pivots, "region").where(F.col("node") != F.col("p")).select("node", "n", "label", "p", "np")
    asked = staged(asked.dropDuplicates(["node", "p"]), "asked")
    discard(regions, pivots)
    pairs = asked.where(_near_sizes("n", "np")).select(F.col("node").alias("a"), F.col("p").alias("b"),
                                                       F.col("n").alias("na"), F.col("np").alias("nb"))
    told = staged(apart(pairs, sets), "apart")
    found = staged(distances(told.where("least is null").select("a", "b"), sets), "distances")
    balls = staged(found.where(_linked()).select("a", "b"), "balls")
    labels = components(names.select("node", "name"), balls).withColumnRenamed("label", "moved")

    # what goes on meets again in the regions of its pivots, larger ones than
    # those of single shingles: members outside the ball, and of the ball those
    # in the window of the nearest member outside
    far = (found.select(F.col("a").alias("node"), F.col("b").alias("p"), _distance().alias("d"), _linked().alias("ball"),
                        _distance().alias("least"))
           .unionByName(told.where("least is not null").select(
               F.col("a").alias("node"), F.col("b").alias("p"), F.lit(None).cast("double").alias("d"), F.lit(False).alias("ball"), "least")))
    rest = (asked.join(far, ["node", "p"], "left")
            # no distance: the signatures or the sizes are too far apart, it is beyond the threshold
            .select(F.col("p").alias("region"), "node", "n", "d", "label", "least", F.coalesce("ball", F.lit(False)).alias("ball")))
    nearest = rest.where(~F.col("ball")).groupBy("region").agg(F.min(F.coalesce("least", F.lit(reach))).alias("nearest"))
    nearest = staged(nearest, "nearest")
    rest = (rest.join(nearest, "region")
            .where(~F.col("ball") | (F.col("d") >= F.col("nearest") - reach)).drop("ball", "nearest", "least"))
    rest = staged(rest.join(labels, "node", "left")
                  .select("region", "node", "n", "d", F.coalesce("moved", "label").alias("label")), "rest")
    discard(asked, told, found, nearest)
    unsettled = staged(measured(rest).where("open > 0"), "unsettled")
    big = staged(rest.join(unsettled, "region"), "open")
    discard(rest, unsettled)
    joined = grid_links(big, sets, reach)
    links = staged(balls.union(joined), "links")
    discard(balls, joined, big, sets)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node, component_id, component, row_key) of every row:
    the size of its shingle set, its set, the smallest id it is connected with
    by links, the smallest set it is connected with, and its ``row_key``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    members = staged(nodes_of(docs), "sets")
    known = staged(members.where("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.min("row_key").alias("row_key")), "names")
    names = known.select("node", F.col("node").alias("name"), "row_key")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least, most = BUCKET_BYTES
    buckets = max(1, math.ceil(size / most), min(BUCKETS, math.ceil(size / least)))
    packed = staged(postings(docs, count_sketch(docs, sketch_bits(size)), buckets), "postings")
    places = staged(meeting_places(packed, buckets), "places")
    discard(packed)
    regions = merged(places)
    sets = sets_of(docs, members, names, regions.select("node").distinct())
    links = recursive_links(regions, sets, names)
    labelled = staged(known.join(components(names.select("node", "name"), links), "node", "left")
                      .select("node", "least", F.coalesce("label", "node").alias("component")), "labelled")
    # sets without a link are their own component; the others take its smallest id
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")).where("sets > 1")
    named = labelled.join(least, "component", "left").select(
        "node", "component", F.when(F.col("sets").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    found = members.join(named, "node", "left")
    return found.select("id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "id").alias("component_id"),
                        "component", "row_key")
