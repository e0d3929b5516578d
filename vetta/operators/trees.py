"""Boosted regression trees over Spark, grown leaf by leaf, all folds at once.

Features are cut into at most ``BINS`` bins, so a row is a few bytes.  A pass
over the rows gives, for every model and every node on its frontier, the sums
of gradients and rows by (feature, bin): tasks add up their own with NumPy and
Spark adds the vectors, partial sums first, so what reaches the driver depends
on the parameters (models x nodes x features x bins), never on the rows.  The
driver picks splits and sends the trees with the next pass.  Passes read
blocks of rows (an Arrow batch as one row of arrays, feature by feature), so
their cost is the kernel's and not that of taking rows to Python one by one.

Leaf-wise growth always splits the leaf of the largest gain.  A leaf's best
split does not depend on other leaves, so a pass looks at the children of all
nodes that could still be chosen; the order of splits is then replayed, and is
exactly that of one split at a time, in as many passes as the tree is deep.

The models (one for each fold) share every pass: each learns from the rows of
the other folds but one, whose mean absolute error stops it after ``patience``
rounds without improvement (all other rows watch themselves where there is
only one other fold).  Predictions so far are a column, kept between rounds
and cut off its lineage every ``CUT_EVERY`` rounds.  Large tables are kept in
``SHARES`` shares, and a share takes the new tree after the one before has dropped
its old state, so that a round does not hold all rows twice.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.plans.lineage import checkpointed, releasing, staged

BINS = 64
DRIVER_BYTES = 32 << 20     # sums of tasks added on the driver at most
TASK_ROWS = 50_000          # rows of a task at least, where the table has so many
SHARES = 4                  # of a large table; one has so many rows at least:
SHARE_ROWS = 5_000_000
FILE_ROWS = 200_000         # of a file of bins, so that tasks get even parts
CUT_EVERY = 25              # rounds between cuts of the lineage
DIGITS = 9                  # significant digits of gains that are compared
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """Fixed values of the reference's booster, and the stopping tolerance."""

    rounds: int = 500
    leaves: int = 31
    rate: float = 0.05
    feature_share: float = 0.8      # drawn for each tree
    row_share: float = 0.8          # drawn every ``row_every`` rounds
    row_every: int = 5
    l1: float = 0.1
    l2: float = 0.1
    least_rows: int = 20            # rows of a leaf
    patience: int = 50
    tolerance: float = 1e-3         # share of the error that counts as improvement
    seed: int = 42


@dataclass
class Tree:
    feature: list = field(default_factory=lambda: [-1])     # -1: a leaf
    cut: list = field(default_factory=lambda: [0])          # bins up to this go left
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def nodes_of(self, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of bins (``own``: of the rows listed).  A right child
        comes directly after its left one."""
        feature, cut, left = (np.asarray(a) for a in (self.feature, self.cut, self.left))
        place = np.arange(len(x)) if own is None else own
        node = np.zeros(len(place), dtype=np.int64)
        if feature[0] < 0 or not len(place):
            return node
        flat, begin, inner = x.T.ravel(), feature * len(x), feature >= 0      # no copy of bins held by feature
        rows, at = None, node
        while len(place):
            at = left[at] + (flat[begin[at] + place] > cut[at])
            if rows is None:
                node, rows = at, np.arange(len(at))
            else:
                node[rows] = at
            on = inner[at]
            rows, place, at = rows[on], place[on], at[on]
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes_of(x)]


@dataclass
class Split:
    gain: float
    feature: int
    cut: int


def _shrunk(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(grad: np.ndarray, rows: np.ndarray, p: Params, features: np.ndarray) -> Split | None:
    """The split of the largest gain from sums by (feature, bin) of ``features``; of
    equal gains the first feature and bin."""
    left_g, left_n = np.cumsum(grad, axis=1)[:, :-1], np.cumsum(rows, axis=1)[:, :-1]
    all_g, all_n = grad[0].sum(), rows[0].sum()
    right_g, right_n = all_g - left_g, all_n - left_n
    ok = (left_n >= p.least_rows) & (right_n >= p.least_rows)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (_shrunk(left_g, p.l1) ** 2 / (left_n + p.l2) + _shrunk(right_g, p.l1) ** 2 / (right_n + p.l2)
                - _shrunk(all_g, p.l1) ** 2 / (all_n + p.l2))
    gain = np.where(ok, gain, -np.inf)
    top = gain.max()
    if not top > 0:
        return None
    # sums of the same rows in another order differ in the last digits
    i = int(np.flatnonzero(gain >= top * (1 - 10.0 ** -DIGITS))[0])
    f, cut = divmod(i, gain.shape[1])
    return Split(float(top), int(features[f]), cut)


class Grower:
    """One tree under growth: the sums of all nodes seen, and the replay."""

    def __init__(self, p: Params, features: np.ndarray):
        self.p, self.features = p, features
        self.tree = Tree()
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.split: dict[int, Split | None] = {}
        self.parent: dict[int, int] = {}
        self.rows_of: dict[int, float] = {}     # rows of the nodes on the frontier
        self.frontier = [0]

    def measured(self) -> list[int]:
        """Nodes of the frontier whose sums a pass must give: of two siblings the
        smaller one, the other is what its parent has besides."""
        if self.frontier == [0]:
            return [0]
        return [min(pair, key=self.rows_of.__getitem__) for pair in zip(self.frontier[::2], self.frontier[1::2])]

    def take(self, node: int, grad: np.ndarray, rows: np.ndarray) -> None:
        for k, g, n in [(node, grad, rows)] + ([] if node == 0 else [self.other(node, grad, rows)]):
            self.sums[k] = g, n
            self.split[k] = best_split(g, n, self.p, self.features)

    def other(self, node: int, grad: np.ndarray, rows: np.ndarray) -> tuple:
        parent = self.parent[node]
        left, right = self.tree.left[parent], self.tree.right[parent]
        g, n = self.sums[parent]
        return right if node == left else left, g - grad, n - rows

    def chosen(self) -> list[int]:
        """Nodes that leaf-wise growth would split, as far as known, in order."""
        t, out = self.tree, []
        heap = [(-self.split[0].gain, 0)] if self.split.get(0) else []
        while heap and len(out) < self.p.leaves - 1:
            _, node = heapq.heappop(heap)
            out.append(node)
            for child in (t.left[node], t.right[node]):
                if child >= 0 and self.split.get(child):
                    heapq.heappush(heap, (-self.split[child].gain, child))
        return out

    def grow(self) -> None:
        """Children for all nodes that may be split; they are the next frontier."""
        t, self.frontier = self.tree, []
        for node in self.chosen():
            if t.left[node] < 0:
                s = self.split[node]
                t.feature[node], t.cut[node] = s.feature, s.cut
                t.left[node], t.right[node] = len(t.feature), len(t.feature) + 1
                for a, v in ((t.feature, -1), (t.cut, 0), (t.left, -1), (t.right, -1), (t.value, 0.0)):
                    a.extend([v, v])
                self.frontier += [t.left[node], t.right[node]]
                rows = self.sums[node][1][int(np.flatnonzero(self.features == s.feature)[0])]
                for child, n in ((t.left[node], rows[:s.cut + 1].sum()), (t.right[node], rows[s.cut + 1:].sum())):
                    self.parent[child], self.rows_of[child] = node, float(n)

    def finished(self) -> Tree:
        """The chosen splits only, with the values of their leaves."""
        chosen, t, out = set(self.chosen()), self.tree, Tree()
        todo = [(0, 0)]
        while todo:
            node, at = todo.pop()
            if node in chosen:
                out.feature[at], out.cut[at] = t.feature[node], t.cut[node]
                out.left[at], out.right[at] = len(out.feature), len(out.feature) + 1
                todo += [(t.left[node], out.left[at]), (t.right[node], out.right[at])]
                for a, v in ((out.feature, -1), (out.cut, 0), (out.left, -1), (out.right, -1), (out.value, 0.0)):
                    a.extend([v, v])
            else:
                g, n = self.sums[node][0][0].sum(), self.sums[node][1][0].sum()
                out.value[at] = float(-_shrunk(g, self.p.l1) / (n + self.p.l2) * self.p.rate) if n else 0.0
        return out


def drawn_features(p: Params, n: int, model: int, round_: int) -> np.ndarray:
    size = max(1, int(round(p.feature_share * n)))
    rng = np.random.default_rng((p.seed, model, round_))
    return np.sort(rng.choice(n, size, replace=False)) if size < n else np.arange(n)


def drawn_rows(p: Params, h: np.ndarray, model: int, round_: int) -> np.ndarray:
    """Rows of a round, by their hash (the draw is renewed every ``row_every`` rounds)."""
    if p.row_share >= 1:
        return np.ones(len(h), dtype=bool)
    salt = (p.seed + 1000 * model + 1_000_003 * (round_ // p.row_every)) * int(MIX) % 2 ** 64
    x = h.view(np.uint64) ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * MIX
    return (x >> np.uint64(32)).astype(np.float64) < p.row_share * 2.0 ** 32


def bin_edges(df: DataFrame, features, bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature but the last, from approximate
    quantiles over all rows (one aggregate); null and NaN have a bin of their own."""
    probs = [float(q) for q in np.linspace(0, 1, bins)[1:-1]]
    value = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    row = df.agg(*[F.percentile_approx(v, probs, 100 * bins).alias(f"q{i}") for i, v in enumerate(value)]).first()
    return [np.unique(np.array(q or [], dtype=np.float64)) for q in row]


def _matrix(col, dtype) -> np.ndarray:
    """Rows of a binary column of equal sizes."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, 1), dtype=dtype)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data.view(dtype).reshape(len(col), -1)


def _binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offsets = (np.arange(len(m) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


ROWS = "row_id string, fold int, y double, h long, bins binary"
BLOCKS = "fold binary, y binary, h binary, bins binary, pred binary"


def binned(df: DataFrame, features, edges, gold: str, fold_col: str) -> DataFrame:
    """Rows as bins."""
    cols = df.select(F.col("row_id").cast("string").alias("row_id"), F.col(fold_col).cast("int").alias("fold"),
                     F.col(gold).cast("double").alias("y"), F.xxhash64("row_id").alias("h"),
                     *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, len(edges)), dtype=np.uint8)
            for i, e in enumerate(edges):
                v = b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64)
                x[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row_id", "fold", "y", "h")), _binary(x)],
                                             names=["row_id", "fold", "y", "h", "bins"])
    return cols.mapInArrow(run, ROWS)


def _squeezed(v: np.ndarray) -> bytes:
    """The bytes of an array, compressed, after their number."""
    raw = v.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _spread(b: bytes) -> pa.Buffer:
    return pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"))


def in_blocks(rows: DataFrame, start: np.ndarray) -> DataFrame:
    """Each Arrow batch of rows as one row of arrays, with the start value of every
    model as prediction so far.  Bins lie feature by feature, predictions model by
    model; all but these are compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fold, y, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y", "h"))
            own = [fold.astype(np.float32), y.astype(np.float64), h.astype(np.int64), _matrix(b.column("bins"), np.uint8).T,
                   np.repeat(start, b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([_squeezed(v)], pa.binary()) for v in own[:-1]]
                                             + [pa.array([own[-1].tobytes()], pa.binary())],
                                             names=["fold", "y", "h", "bins", "pred"])
    return rows.select("fold", "y", "h", "bins").mapInArrow(run, BLOCKS)


def _blocks(b: pa.RecordBatch) -> Iterator[tuple]:
    """(fold, y, h, bins by feature, predictions by model) of the blocks of a batch."""
    for i in range(b.num_rows):
        fold, y, h, x = (np.frombuffer(_spread(b.column(c)[i].as_py()), dtype=t) for c, t in (
            ("fold", np.float32), ("y", np.float64), ("h", np.int64), ("bins", np.uint8)))
        pred = np.frombuffer(b.column("pred")[i].as_buffer(), dtype=np.float64)
        yield fold, y, h, x.reshape(-1, len(y)), pred.reshape(-1, len(y))


class Model:
    """Trees of one held-out fold and what stops them."""

    def __init__(self, fold: int, inner: int | None):
        self.fold, self.inner = fold, inner
        self.trees: list[Tree] = []
        self.best, self.best_round, self.done = np.inf, 0, False

    def learns(self, fold: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = (fold != self.fold) & ~np.isnan(y)
        return out if self.inner is None else out & (fold != self.inner)

    def watches(self, fold: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.learns(fold, y) if self.inner is None else (fold == self.inner) & ~np.isnan(y)

    def heard(self, error: float, p: Params) -> None:
        """The watched error with all trees so far."""
        if error < self.best * (1 - p.tolerance):
            self.best, self.best_round = error, len(self.trees)
        elif len(self.trees) - self.best_round >= p.patience:
            self.done = True
        if len(self.trees) >= p.rounds:
            self.done = True


def with_tree(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Predictions so far (of ``in_blocks``) with one more tree for each model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for _, _, _, x, pred in _blocks(b):
                pred = pred.copy()
                for m, t in trees.items():
                    pred[m] += t.predict(x.T)
                new.append(pred.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.binary())], names=b.schema.names)
    return rows.mapInArrow(run, BLOCKS)


def _cells(x: np.ndarray, features: np.ndarray, rows: np.ndarray, node: np.ndarray, grad: np.ndarray, n_nodes: int,
           n_bins: int) -> np.ndarray:
    """Sums of gradients and rows by (node, feature, bin), shape (2, nodes, features, bins)."""
    out = np.empty((2, len(features), n_nodes * n_bins))
    at = node * n_bins
    for i, f in enumerate(features):
        cell = at + x[f][rows]
        out[0, i] = np.bincount(cell, grad, n_nodes * n_bins)
        out[1, i] = np.bincount(cell, minlength=n_nodes * n_bins)
    return out.reshape(2, len(features), n_nodes, n_bins).transpose(0, 2, 1, 3)


def _added(table: pa.Table) -> pa.Table:
    """One row for each model: its vectors added up."""
    model, v = table.column("model").to_numpy(), table.column("v")
    out = {}
    for m, x in zip(model, v):
        y = np.frombuffer(x.as_buffer(), dtype=np.float64)
        out[m] = out[m] + y if m in out else y
    part = table.column("part").to_numpy()[0]
    return pa.table({"model": pa.array(list(out), pa.int32()), "part": pa.array([part] * len(out), pa.int32()),
                     "v": pa.array([y.tobytes() for y in out.values()], pa.binary())})


def sums(rows: DataFrame, models: dict[int, Model], growing: dict[int, Grower], p: Params, round_: int, n_bins: int,
         errors: bool, parts: int) -> dict:
    """One pass: (model, node): gradients and rows by (feature, bin) of the nodes
    to be measured, and with ``errors`` under (model, -1) the watched error and
    rows.  Every task gives one vector a model; up to ``DRIVER_BYTES`` of them are
    added on the driver, more by Spark, at most ``sqrt(parts)`` in a task."""
    jobs = {m: (models[m], g.tree, np.array(g.measured()), g.features) for m, g in growing.items()}
    fan = max(1, int(np.sqrt(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, h = {}, np.zeros(0, np.int64)
        for fold, y, h, x, pred in (block for b in batches for block in _blocks(b)):
            for m, (model, tree, nodes, features) in jobs.items():
                head = np.zeros(2)
                if errors:
                    w = model.watches(fold, y)
                    head[:] = np.abs(pred[m][w] - y[w]).sum(), w.sum()
                at = np.flatnonzero(model.learns(fold, y) & drawn_rows(p, h, m, round_))
                place = np.full(len(tree.feature), -1)
                place[nodes] = np.arange(len(nodes))
                node = place[tree.nodes_of(x.T, at)]
                used = np.flatnonzero(node >= 0)
                own = at[used]
                cells = _cells(x, features, own, node[used], pred[m][own] - y[own], len(nodes), n_bins)
                v = np.concatenate([head, cells.ravel()])
                out[m] = out[m] + v if m in out else v
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([int(h[0] % fan)] * len(out), pa.int32()),
                                              pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["model", "part", "v"])

    schema = "model int, part int, v binary"
    found = rows.mapInArrow(run, schema)
    size = 8 * sum(2 + 2 * len(nodes) * len(features) * n_bins for _, _, nodes, features in jobs.values())
    if parts * size > DRIVER_BYTES:
        found = found.groupBy("model", "part").applyInArrow(_added, schema).withColumn("part", F.lit(0))
        found = found.groupBy("model", "part").applyInArrow(_added, schema)
    out, total = {}, {}
    for r in found.collect():
        v = np.frombuffer(r["v"], dtype=np.float64)
        total[r["model"]] = total[r["model"]] + v if r["model"] in total else v
    for m, v in total.items():
        _, _, nodes, features = jobs[m]
        out[m, -1] = v[:2]
        cells = v[2:].reshape(2, len(nodes), len(features), n_bins)
        for i, node in enumerate(nodes.tolist()):
            out[m, node] = cells[:, i]
    return out


def _next(rows: DataFrame, trees: dict[int, Tree], round_: int) -> DataFrame:
    """The kept state of a share with one more tree for each model."""
    new = with_tree(rows, trees).persist(StorageLevel.MEMORY_AND_DISK)
    if round_ % CUT_EVERY == 0:
        cut = checkpointed(new).persist(StorageLevel.MEMORY_AND_DISK)
        new.unpersist()
        return cut
    return new


def binned_table(df: DataFrame, features, edges, gold: str, fold_col: str) -> DataFrame:
    """A table of ``binned``: every pass would plan the features again otherwise."""
    rows = binned(df, features, edges, gold, fold_col)
    if df.schema["row_id"].dataType.typeName() != "string":
        return staged(rows, "bins", FILE_ROWS)
    # the hash is as long as all else of a row: taken again from the row id
    return staged(rows.drop("h"), "bins", FILE_ROWS).withColumn("h", F.xxhash64("row_id"))


def _shares(base: DataFrame, n_rows: int) -> list[DataFrame]:
    """``base`` in shares, by the rows' hash; few tasks for small tables, as a pass is
    short."""
    n = max(1, min(SHARES, n_rows // SHARE_ROWS))
    few = max(1, n_rows // TASK_ROWS, base.sparkSession.sparkContext.defaultParallelism // 2)
    few, parts = -(-few // n), base.rdd.getNumPartitions()
    own = [base] if n == 1 else [base.where(F.pmod("h", F.lit(n)) == i) for i in range(n)]
    return [r.coalesce(few) if few < parts else r for r in own]


def boost(df: DataFrame, features, gold: str, fold_col: str,
          folds: list[tuple[int, int | None]] | Callable[[set], list[tuple[int, int | None]]], p: Params = Params(),
          edges=None) -> tuple[DataFrame, list[Model], list[np.ndarray], np.ndarray]:
    """Trains a model for each (held-out fold, watched fold or None); ``folds`` may
    tell them from the folds that have gold.  Returns the binned rows, the models with
    their best trees, the bin edges and the start value of each model."""
    features = list(features)
    with releasing(df.sparkSession):
        edges = bin_edges(df, features) if edges is None else edges
    n_bins = max((len(e) for e in edges), default=0) + 2
    base = binned_table(df, features, edges, gold, fold_col)
    by_fold = {r["f"]: (r["s"], r["n"]) for r in       # one row for each fold
               base.where(F.col("y").isNotNull()).groupBy(F.col("fold").alias("f"))
               .agg(F.sum("y").alias("s"), F.count("y").alias("n")).collect()}
    models = {i: Model(f, inner) for i, (f, inner) in enumerate(folds(set(by_fold)) if callable(folds) else folds)}
    start = np.zeros(max(1, len(models)))
    for i, m in models.items():
        own = [v for f, v in by_fold.items() if f != m.fold and f != m.inner]
        start[i] = sum(s for s, _ in own) / max(1, sum(n for _, n in own))
    shares = [in_blocks(r, start).persist(StorageLevel.MEMORY_AND_DISK) for r in _shares(base, base.count())]
    parts = [r.rdd.getNumPartitions() for r in shares]
    last = {}
    for round_ in range(p.rounds + 1):
        live = {i: m for i, m in models.items() if not m.done}
        if not live:
            break
        growing = {i: Grower(p, drawn_features(p, len(features), i, round_)) for i in live}
        first = True
        while growing_now := {i: g for i, g in growing.items() if g.frontier}:
            if first:
                found = {}
                for k, old in enumerate(shares):
                    if last:
                        shares[k] = _next(old, {i: t for i, t in last.items() if i in live}, round_)
                    for at, v in sums(shares[k], models, growing_now, p, round_, n_bins, True, parts[k]).items():
                        found[at] = found[at] + v if at in found else v
                    if last:
                        old.unpersist(True)
            else:
                found = sums(functools.reduce(DataFrame.union, shares), models, growing_now, p, round_, n_bins, False, sum(parts))
            for (i, node), v in found.items():
                if node >= 0:
                    growing[i].take(node, *v)
                elif first:
                    live[i].heard(v[0] / max(1.0, v[1]), p)
            if first:
                growing = {i: g for i, g in growing.items() if not live[i].done}
                first = False
            for i, g in growing.items():
                if g.frontier:
                    g.grow()
            if not found:
                break
        last = {i: g.finished() for i, g in growing.items() if g.sums}
        for i, t in last.items():
            models[i].trees.append(t)
        for i in live:
            if i not in last:
                models[i].done = True
    for r in shares:
        r.unpersist()
    for m in models.values():
        m.trees = m.trees[:m.best_round]
    return base, list(models.values()), edges, start


def held_out(rows: DataFrame, models: list[Model], start: np.ndarray, out: str) -> DataFrame:
    """``row_id``, ``fold`` and the prediction of each row by the model of its
    fold; null where that fold has none."""
    of = {m.fold: (i, m) for i, m in enumerate(models)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, fold = _matrix(b.column("bins"), np.uint8), b.column("fold").to_numpy()
            pred = np.full(len(fold), np.nan)
            for f, (i, m) in of.items():
                at = np.flatnonzero(fold == f)
                if len(at):
                    pred[at] = start[i] + sum((t.predict(x[at]) for t in m.trees), np.zeros(len(at)))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(fold.astype(np.int64)),
                                              pa.array(pred, mask=np.isnan(pred))], names=["row_id", "fold", out])
    return rows.select("row_id", "fold", "bins").mapInArrow(run, f"row_id string, fold long, `{out}` double")


def importances(models: list[Model], features) -> list[tuple[str, float]]:
    """Number of splits on each feature, averaged over the models."""
    n = np.zeros(len(features))
    for m in models:
        for t in m.trees:
            n += np.bincount([f for f in t.feature if f >= 0], minlength=len(features))
    return [(f, float(v)) for f, v in zip(features, n / max(1, len(models)))]
