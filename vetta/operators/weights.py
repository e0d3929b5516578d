"""Continuous weight search by exact line search over tau breakpoints.

Along one weight, with the others fixed, the blended difference of two rows
of a source is linear, so its sign flips at most once.  The objective (mean
per-source tau) is therefore constant between breakpoints, and a pass that
sums the jumps of all pairs in bins of the line gives its value on the left of
every bin, the interval where it holds (to the last breakpoint before and the
first one after), and a bound of all values inside a bin: the value before it
plus its upward jumps.  Bins whose bound beats the best value (or, on its left, is
equal) are cut into smaller ones until none is left: the line's maximum and its
first interval are exact, without listing or sorting the breakpoints.

``search`` moves along the weight that gains most until none gains.  All
weights, all starts and all folds are searched in the same passes over one
persisted frame whose tasks stream the pairs in bounded runs.  A pass costs
pairs x weights x tracks; nothing grows with a power of the number of signals.

All pairs of all sources take part.  Those of sources above ``sourceruns.WHOLE``
rows are dealt out as pairs of blocks of distinct points, so that a source is not
one task's work; a pass over them still costs the square of a source's points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.operators import blend, pairstats, sourceruns

BINS = 8192                # bins of a line in the first pass, and new ones of each refinement: few passes
PASS_BINS = 1 << 17        # of all lines of a pass (a task returns as many rows at most), but
LEAST_BINS = 64            # so many of each
GAIN = 1e-9                # values that differ by less are equal, a move counts if it gains more
SAME = 1e-12               # sums of the same jumps in another order
PLACES = 9                 # decimal places of breakpoints (equal ones come by different float paths)
PROFILE = "track int, line int, bin int, net double, up double, low double, high double"


def _sums(edges):
    """Empty sums of the lines: (track, line): by bin the jumps, the upward jumps, the
    first and last breakpoint; the value right of 0 and the number of defined sources."""
    return {(t, j): [np.zeros(len(e)), np.zeros(len(e)), np.full(len(e), np.inf), np.full(len(e), -np.inf), 0.0, 0]
            for t, lines in enumerate(edges) for j, e in enumerate(lines) if e is not None}


def _rest(columns, w, j: int):
    """The blend of a track without its weight ``j``."""
    rest = np.zeros(len(columns[0]))
    for i, v in enumerate(w):
        if i != j:
            rest = rest + columns[i] * v
    return rest


def _add(a: list, e: np.ndarray, d0: np.ndarray, d1: np.ndarray, gain: np.ndarray) -> None:
    """Adds pairs to the sums of a line: their differences at 0 and for each step along
    it, and the gold sign times what a pair counts (0: nowhere)."""
    level = np.flatnonzero(d0 == 0)
    side = np.sign(d0)
    side[level] = np.sign(d1[level])
    a[4] += float((side * gain).sum())
    flips = np.flatnonzero((d0 * d1 < 0) & (np.abs(d0) < np.abs(d1)) & (gain != 0))
    d1 = d1[flips]
    at = np.round(-d0[flips] / d1, PLACES)
    jump = 2.0 * np.sign(d1) * gain[flips]
    b = np.searchsorted(e, at, "right") - 1
    a[0] += np.bincount(b, jump, len(e))
    a[1] += np.bincount(b, np.maximum(jump, 0.0), len(e))
    np.minimum.at(a[2], b, at)
    np.maximum.at(a[3], b, at)


def _profile(sums) -> Iterator[pd.DataFrame]:
    for (t, j), (net, up, low, high, base, n) in sums.items():
        used = np.flatnonzero(np.isfinite(low))
        yield pd.DataFrame({"track": np.int32(t), "line": np.int32(j), "bin": np.concatenate(([-1], used)).astype(np.int32),
                            "net": np.concatenate(([base], net[used])), "up": np.concatenate(([float(n)], up[used])),
                            "low": np.concatenate(([0.0], low[used])), "high": np.concatenate(([0.0], high[used]))})


def _bin_sums(read, tracks, edges):
    """Kernel of a pass over small sources.  ``tracks``: (weights, held-out fold or None);
    ``edges[track][line]``: sorted places in [0, 1].  For each bin the sum of
    jumps, of upward jumps, and the first and last breakpoint; bin -1 has the
    value right of 0 and the number of defined sources."""
    def run(batches):
        acc, some = _sums(edges), False
        for r in read(batches):
            some = True
            s = sourceruns.signs(r)
            source, left_over = r.source, r.n_pairs - s.gold_ties
            columns = [np.ascontiguousarray(c) for c in r.x.T]
            own = {j: r.difference(columns[j]) for j in {j for _, j in acc}}
            for t, (w, held) in enumerate(tracks):
                counted = s.whole if held is None else s.whole & (r.fold != held)
                for j, e in enumerate(edges[t]):
                    if e is None:
                        continue
                    d0, d1 = r.difference(_rest(columns, w, j)), own[j]
                    level = np.flatnonzero(d0 == 0)
                    tied = np.bincount(source[level[d1[level] == 0]], minlength=len(r.n_pairs))
                    den = (r.n_pairs - tied) * left_over
                    ok = (den > 0) & counted
                    # gold sign over the root; 0 for a pair that counts nowhere
                    gain = np.where(ok, 1.0 / np.sqrt(np.where(den > 0, den, 1.0)), 0.0)[source] * s.gold
                    acc[t, j][5] += int(ok.sum())
                    _add(acc[t, j], e, d0, d1, gain)
        yield from _profile(acc if some else {})
    return run


def _block_sums(tracks, edges):
    """Kernel of a pass over pairs of blocks of large sources, as ``_bin_sums``;
    ``units`` has what a pair of the source counts on each line (0: nowhere)."""
    def run(batches):
        acc, some = _sums(edges), False
        for rows in batches:
            for n_left, head, units, *own in rows[["n_left", "head", "units", "x", "y", "c"]].itertuples(index=False, name=None):
                some = True
                x, y, c = (np.frombuffer(v) for v in own)
                columns = [np.ascontiguousarray(v) for v in x.reshape(len(y), -1).T]
                asked = [(at, e, _rest(columns, tracks[at[0]][0], at[1]), unit)
                         for (at, e), unit in zip(((at, edges[at[0]][at[1]]) for at in acc), units) if unit > 0]
                for at, *_ in asked:
                    acc[at][5] += bool(head)
                finite = max(np.abs(v).max() for v in [*columns, *(rest for _, _, rest, _ in asked)]) < sourceruns.HUGE
                for left, right in sourceruns.block_runs(n_left, y):
                    gold = np.sign(y[left] - y[right]) * c[left] * c[right]
                    steps = {}
                    for at, e, rest, unit in asked:
                        if at[1] not in steps:
                            steps[at[1]] = columns[at[1]][left] - columns[at[1]][right]
                        d0, d1 = rest[left] - rest[right], steps[at[1]]
                        if not finite:
                            d0, d1 = np.nan_to_num(d0), np.nan_to_num(d1)
                        _add(acc[at], e, d0, d1, gold * unit)
        yield from _profile(acc if some else {})
    return run


def _units(sources: blend.Sources, tracks, edges) -> DataFrame:
    """``doc_id, units``: what a pair of each large source counts on the lines, in their
    order: 1 over the root of the pairs not tied in the blend (none is, where two points
    differ along the line) times those not tied in gold; 0 without a tau or in the
    held-out fold."""
    lines = list(_sums(edges))
    places = []
    for i, (t, j) in enumerate(lines):
        rest = F.lit(0.0)
        for s, (name, v) in enumerate(zip(sources.signals, tracks[t][0])):
            rest = rest if s == j else rest + F.col(name) * F.lit(float(v))
        held = tracks[t][1]
        counts = F.lit(True) if held is None else F.col("fold") != F.lit(held)
        places.append(F.struct(F.lit(i).alias("i"), rest.alias("rest"), F.col(sources.signals[j]).alias("own"), counts.alias("counts")))
    alike = sources.points.select("doc_id", "_c", F.explode(F.array(*places)).alias("p")) \
        .groupBy("doc_id", "p.i", "p.rest", "p.own", "p.counts").agg(F.sum("_c").alias("s"))
    tied = alike.groupBy("doc_id", "i", "counts").agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("tied"))
    den = (F.col("pairs") - F.col("tied")) * F.col("unlike")
    unit = F.when(F.col("counts") & (den > 0), 1 / F.sqrt(den)).otherwise(F.lit(0.0))
    found = tied.join(sources.pairs, "doc_id").select("doc_id", F.struct("i", unit.alias("unit")).alias("u"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("u")).getField("unit").alias("units"))


def bin_profile(sources: blend.Sources, tracks, edges) -> pd.DataFrame:
    """The bins of every line, summed over the pairs of all sources (tracks x weights x
    bins rows)."""
    out = sources.small.mapInPandas(_bin_sums(sources.read, tracks, edges), PROFILE)
    if sources.n_big:
        units = pairstats.maybe_broadcast(_units(sources, tracks, edges), sources.n_big)
        out = out.unionByName(sources.blocks.join(units, "doc_id").mapInPandas(_block_sums(tracks, edges), PROFILE))
    return out.groupBy("track", "line", "bin").agg(F.sum("net").alias("net"), F.sum("up").alias("up"),
                                                   F.min("low").alias("low"), F.max("high").alias("high")).toPandas()


class Line:
    """What is known of one line: value and interval on the left of each bin."""

    def __init__(self, edges: np.ndarray, rows: pd.DataFrame):
        self.edges = edges
        top = rows[rows["bin"] < 0]
        base, self.n = (float(top["net"].iloc[0]), float(top["up"].iloc[0])) if len(top) else (0.0, 0.0)
        rows = rows[rows["bin"] >= 0].sort_values("bin")
        n = self.n or 1.0
        net, up = rows["net"].to_numpy() / n, rows["up"].to_numpy() / n
        self.low, self.high = rows["low"].to_numpy(), rows["high"].to_numpy()
        # places: before the first bin with breakpoints, between two, after the last
        self.value = base / n + np.concatenate(([0.0], np.cumsum(net)))
        self.begin = np.concatenate(([0.0], self.high))
        self.end = np.concatenate((self.low, [1.0]))
        self.bound = self.value[:-1] + up

    def best(self) -> tuple[float, float, float]:
        """(value, begin, end) of the best known interval, the leftmost of equal ones."""
        if not self.n:
            return 0.0, 0.0, 1.0
        open_ = self.end > self.begin
        value = np.where(open_, self.value, -np.inf)
        i = int(np.flatnonzero(value >= value.max() - GAIN)[0])
        return float(value[i]), float(self.begin[i]), float(self.end[i])

    def finer(self, bins: int) -> np.ndarray | None:
        """Edges with the bins cut, into ``bins`` or so, that may hold a better value, or
        an equal one on the left of the best; None if none may."""
        if not self.n:
            return None
        value, begin, _ = self.best()
        # ``best`` may be GAIN below the top of the known values
        top = np.where(self.end > self.begin, self.value, value).max()
        better = (self.bound > top + SAME) | ((self.bound >= top - GAIN) & (self.high <= begin))
        doubt = np.flatnonzero(better & (self.high > self.low))
        if not len(doubt):
            return None
        m = max(2, bins // len(doubt))
        new = [np.linspace(self.low[i], self.high[i], m + 1) for i in doubt]
        finer = np.unique(np.concatenate([self.edges, *new]))
        return finer if len(finer) > len(self.edges) else None


def _bins(n_lines: int) -> int:
    return max(min(BINS, LEAST_BINS), min(BINS, PASS_BINS // max(1, n_lines)))


def exact_lines(sources: blend.Sources, tracks, wanted=None) -> dict[tuple[int, int], Line]:
    """The line of every weight through every track's weights (``wanted``: of the
    lines listed), exact over all sources.  A line whose other weights are
    all zero is left out: every place on it is the same blend."""
    k = len(sources.signals)
    used = [[(wanted is None or (t, j) in wanted) and sum(w) - w[j] > 0 for j in range(k)] for t, (w, _) in enumerate(tracks)]
    start = np.linspace(0.0, 1.0, _bins(sum(map(sum, used))) + 1)[:-1]
    edges = [[start if u else None for u in own] for own in used]
    lines = {}
    while any(e is not None for own in edges for e in own):
        rows = bin_profile(sources, tracks, edges)
        bins = _bins(sum(e is not None for own in edges for e in own))
        for t, own in enumerate(edges):
            for j, e in enumerate(own):
                if e is not None:
                    lines[t, j] = Line(e, rows[(rows["track"] == t) & (rows["line"] == j)])
                    own[j] = lines[t, j].finer(bins)
    return lines


def _objective(sources: blend.Sources, candidates, held) -> np.ndarray:
    """Mean tau of each candidate over the sources outside its held-out fold; equal
    candidates are scored once for all folds."""
    candidates = [tuple(map(float, c)) for c in candidates]
    scored = list(dict.fromkeys(candidates))
    sums = {c: [] for c in scored}
    for r in sources.tau_sums(scored).collect():        # a row a fold and candidate
        sums[scored[int(r["cand"])]].append((int(r["fold"]), r["sum_tau"], r["n_def"]))
    total, n = np.zeros((2, len(candidates)))
    for i, c in enumerate(candidates):
        for fold, tau, defined in sums[c]:
            if held[i] is None or fold != held[i]:
                total[i] += tau
                n[i] += defined
    return np.where(n > 0, total / np.maximum(n, 1), 0.0)


def _starts(k: int) -> list[tuple[float, ...]]:
    """Equal weights, each signal alone, and up to four signals the fixed grid."""
    own = [tuple([1.0] * k), *(tuple(float(i == j) for i in range(k)) for j in range(k))]
    return own + [c for c in blend.candidate_grid(k) if c not in own] if k <= 4 else own


def _climb(sources: blend.Sources, held: list) -> list[tuple[tuple[float, ...], float]]:
    """(weights, mean tau) for each held-out fold of ``held`` (None: no fold)."""
    k = len(sources.signals)
    starts = _starts(k)
    values = _objective(sources, [c for _ in held for c in starts], [h for h in held for _ in starts]).reshape(len(held), -1)
    at = [int(np.flatnonzero(v >= v.max() - GAIN)[0]) for v in values]
    tracks = [(starts[i], h) for i, h in zip(at, held)]
    value = [float(v[i]) for v, i in zip(values, at)]
    moving = set(range(len(held))) if k > 1 else set()
    while moving:               # each move gains, so there is a last one
        lines = exact_lines(sources, tracks, {(t, j) for t in moving for j in range(k)})
        tried = []
        for (t, j), line in lines.items():
            v, a, b = line.best()
            if v > value[t] + GAIN:
                tried.append((t, tuple((a + b) / 2 if i == j else x for i, x in enumerate(tracks[t][0]))))
        moved = set()
        if tried:
            # a place inside an interval may still differ by rounding: compare whole objectives
            found = _objective(sources, [c for _, c in tried], [held[t] for t, _ in tried])
            for (t, c), v in sorted(zip(tried, found), key=lambda x: (x[0][0], -x[1], x[0][1])):
                if t not in moved and v > value[t] + GAIN:
                    tracks[t], value[t] = (c, held[t]), float(v)
                    moved.add(t)
        moving = moved
    return [(w, v) for (w, _), v in zip(tracks, value)]


def line_optima(df: DataFrame, signals, weights=None, gold: str = "score") -> DataFrame:
    """For each signal the best mean tau along its weight, the others as in
    ``weights`` (1 each), and the interval of weights that has it:
    ``signal, tau, low, high``."""
    weights = tuple(map(float, weights or [1.0] * len(signals)))
    sources = blend.Sources(df, signals, gold, small=sourceruns.WHOLE).persist()
    try:
        lines = exact_lines(sources, [(weights, None)])
    finally:
        sources.unpersist()
    rows = [(s, *lines[0, j].best()) for j, s in enumerate(signals) if (0, j) in lines]
    return df.sparkSession.createDataFrame(rows, "signal string, tau double, low double, high double")


def search(df: DataFrame, signals, gold: str = "score") -> DataFrame:
    """Weights in [0, 1] that no move along one weight improves, started from the
    best of ``_starts``: ``signal, weight, tau``."""
    sources = blend.Sources(df, signals, gold, small=sourceruns.WHOLE).persist()
    try:
        (w, tau), = _climb(sources, [None])
    finally:
        sources.unpersist()
    return df.sparkSession.createDataFrame([(s, float(x), tau) for s, x in zip(signals, w)],
                                           "signal string, weight double, tau double")


def cross_validated(df: DataFrame, signals, k: int = blend.N_FOLDS, gold: str = "score", seed: int = blend.SEED) -> DataFrame:
    """For each fold the weights found on the other folds' sources, their mean
    tau there and on the fold's own: ``fold, w_<signal>.., train_tau, val_tau``.
    All folds climb in the same passes."""
    sources = blend.Sources(df.withColumn("_fold", blend.doc_fold("doc_id", k, seed)), signals, gold, "_fold", sourceruns.WHOLE).persist()
    try:
        found = _climb(sources, list(range(k)))
        rows = sources.tau_sums([w for w, _ in found]).collect()
    finally:
        sources.unpersist()
    own = {int(r["cand"]): r["sum_tau"] / r["n_def"] for r in rows if r["fold"] == r["cand"] and r["n_def"]}
    return df.sparkSession.createDataFrame(
        [(f, *map(float, w), tau, float(own.get(f, 0.0))) for f, (w, tau) in enumerate(found)],
        "fold long, " + ", ".join(f"w_{s} double" for s in signals) + ", train_tau double, val_tau double")
