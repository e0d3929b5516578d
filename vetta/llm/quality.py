"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Every document becomes a vector of statistics of its whole text (never its
id, language or source).  Random Fourier features of the standardised vector
approximate a Gaussian kernel; partitions sum the normal equations of the
labelled rows, the driver solves one small system (its size is a parameter),
and pooled adjacent violators over a histogram of bounded size calibrate the
ridge values to scores from 0 to 1.

Means and deviations come from all documents, the normal equations and the
calibration from all labelled documents outside the held-out fold; nothing is
sampled.

Defined cases: a null text counts as empty and is scored by its all-zero
statistics; equal texts get equal scores; without any label every score is
0.5; an empty table gives an empty result; rows with a null label do not
train.  The operator returns (id, score) for each input row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm import words as W
from vetta.llm.common import staged
from vetta.llm.labels import train_labels

FEATURES = 256                  # random Fourier features
GAMMA = 0.05                    # Gaussian kernel: exp(-GAMMA * |x - y|^2)
RIDGE = 1e-3                    # ridge penalty for each training row
BINS = 2048                     # histogram bins of the calibration
SEED = 17
SLICE_BYTES = 4 << 20

# character classes that the statistics count, by first byte
CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol", "other", "high")
N_STATS = 27


def byte_classes() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), dtype=np.int64)
    t[65:91], t[97:123], t[48:58], t[128:] = 0, 1, 2, 11
    t[[32, 9]], t[[10, 11, 12, 13]] = 3, 4
    for chars, name in ((".", "stop"), (",;:", "comma"), ("!?", "bang"), ("|", "bar"), ("#$%&*@^~_=+<>{}[]\\/", "symbol")):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    return t


def statistics(col) -> np.ndarray:
    """One row of ``N_STATS`` statistics for each text of an Arrow column."""
    w = W.split_words(col)
    data, offsets = W.text_buffer(col)
    n = len(col)
    out = np.zeros((n, N_STATS))
    size = np.diff(offsets).astype(float)
    if not len(data):
        return out
    k = len(CLASSES)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.bincount(row * k + byte_classes()[data], minlength=n * k).reshape(n, k)
    out[:, :k] = counts / np.maximum(size, 1)[:, None]
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(w.n_words)
    n_words = np.maximum(w.n_words, 1)
    length = (w.end - w.start).astype(float)

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.row, weights=values, minlength=n)

    mean = by_row(length) / n_words
    out[:, k + 2] = mean
    out[:, k + 3] = np.sqrt(np.maximum(by_row(length ** 2) / n_words - mean ** 2, 0))
    out[:, k + 4] = by_row(length <= 3) / n_words
    out[:, k + 5] = by_row(length >= 12) / n_words
    kind = byte_classes()
    first, last = kind[data[w.start]], kind[data[w.end - 1]]
    out[:, k + 6] = by_row(first == 0) / n_words
    out[:, k + 7] = by_row(last == 0) / n_words
    out[:, k + 8] = by_row(np.isin(last, (7, 8, 9, 10))) / n_words
    out[:, k + 9] = by_row(last == 5) / n_words
    lines = counts[:, 4] + (size > 0)
    out[:, k + 10] = np.log1p(size / np.maximum(lines, 1))
    out[:, k + 11] = np.log1p(lines)
    # different words and word pairs, and the most frequent word, by row
    h = W.word_hashes(w)
    order = np.lexsort((h, w.row))
    r, s = w.row[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    out[:, k + 12] = np.bincount(r[new], minlength=n) / n_words
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(s))))
    out[:, k + 13] = top / n_words
    pair = W.window_hashes(h, 2)
    pair_row = w.row[:-1][W.window_valid(w, 2)]
    pair = pair[W.window_valid(w, 2)]
    order = np.lexsort((pair, pair_row))
    r, s = pair_row[order], pair[order]
    again = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
    out[:, k + 14] = np.bincount(r[1:][again], minlength=n) / n_words
    return out


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every text, as an array of floats."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in W.byte_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                x = statistics(part.column("text")).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return (rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of statistics, and a constant."""
    weights, phase = projection()
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ weights + phase) * np.sqrt(2 / FEATURES)
    return np.hstack([z, np.ones((len(z), 1))])


def _matrix(series) -> np.ndarray:
    return np.array(series.to_list(), dtype=float).reshape(len(series), N_STATS)


def moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over all documents."""
    cols = [F.col("x")[i].cast("double") for i in range(N_STATS)]
    row = stats.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    values = np.array([v or 0.0 for v in row], dtype=float)
    scale = values[N_STATS:]
    return values[:N_STATS], np.where(scale > 1e-9, scale, 1.0)


def normal_equations(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z' and z y over the training rows: partition sums, one row for
    each row of the matrix, then sums by matrix row."""
    d = FEATURES + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, rows = np.zeros((d, d + 1)), 0
        for batch in batches:
            if len(batch):
                z = fourier(_matrix(batch["x"]), mean, scale)
                a += z.T @ np.column_stack([z, batch["y"].to_numpy(float)])
                rows += len(z)
        if rows:
            yield pd.DataFrame({"i": np.arange(d), "v": list(a)})

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(group["v"].to_list()), axis=0)]})

    schema = "i int, v array<double>"
    rows = (train.select("x", "y").mapInPandas(part, schema).groupBy("i").applyInPandas(add, schema).collect())
    a = np.zeros((d, d + 1))
    for row in rows:                            # FEATURES + 1 rows at any input size
        a[row.i] = row.v
    return a[:, :-1], a[:, -1], int(round(a[-1, -2]))


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the non-decreasing shares nearest to
    ``good / n`` by weight ``n``; bins without rows take a neighbour's."""
    pools: list[list[float]] = []               # rows, good rows, bins
    for rows, hits in zip(n, good):
        pools.append([rows, hits, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            rows2, hits2, bins2 = pools.pop()
            pools[-1] = [pools[-1][0] + rows2, pools[-1][1] + hits2, pools[-1][2] + bins2]
    return np.concatenate([np.full(int(b), h / r if r else np.nan) for r, h, b in pools])


def fit(stats: DataFrame, known: DataFrame) -> dict:
    """Model from (id, x) rows and (id, y) labels."""
    mean, scale = moments(stats)
    train = staged(stats.join(known, "id"), "quality-train")
    a, b, rows = normal_equations(train, mean, scale)
    if not rows:
        return {}
    weights = np.linalg.solve(a + RIDGE * rows * np.eye(len(a)), b)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"bin": _bin(fourier(_matrix(batch["x"]), mean, scale) @ weights), "y": batch["y"]})

    counts = np.zeros((BINS, 2))
    for row in (train.select("x", "y").mapInPandas(bins, "bin int, y int").groupBy("bin")
                .agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()):
        counts[row.bin] = row.n, row.good       # at most BINS rows
    return {"mean": mean, "scale": scale, "weights": weights, "levels": _levels(counts)}


def _bin(value: np.ndarray) -> np.ndarray:
    """Histogram bin of ridge values; labels are 0 and 1, so -0.5 to 1.5."""
    return np.clip((value + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)


def _levels(counts: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(counts[:, 0])
    steps = isotonic(counts[full, 0], counts[full, 1])
    # half a row of each class keeps scores inside (0, 1)
    total = counts[:, 0].sum()
    steps = (steps * total + 0.5) / (total + 1)
    return np.interp(np.arange(BINS), full, steps)


def score(stats: DataFrame, model: dict) -> DataFrame:
    """(id, score) of every (id, x) row."""
    schema = f"id {stats.schema['id'].dataType.simpleString()}, score double"
    if not model:
        return stats.select("id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                value = fourier(_matrix(batch["x"]), model["mean"], model["scale"]) @ model["weights"]
                # position inside the bin breaks ties of the steps
                yield pd.DataFrame({"id": batch["id"], "score": np.clip(
                    model["levels"][_bin(value)] + 1e-6 * np.clip(value - 0.5, -1, 1), 0, 1)})

    return stats.mapInPandas(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, score) of every document: how likely its label is 1."""
    stats = staged(with_statistics(docs, id_col, text_col), "statistics")
    return score(stats, fit(stats, train_labels(labels, label, id_col)))
