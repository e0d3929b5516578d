"""Exact within-group pair statistics without materialising pairs.

Kendall's tau, pairwise agreement inside a tolerance band and soft pairwise
accuracy all reduce to counting ordered pairs (d, q) of one group with
``a_d < a_q`` (1-D) or ``a_d < a_q and b_d </> b_q`` (2-D dominance).

Three tiers, chosen per group from its row count:

1. ``n <= SMALL_GROUP``: the group is collected into a bounded array and the
   pairs are looped over by Spark higher-order functions (JVM side, no rows
   emitted).  Typical source groups hold a handful of systems.
2. ``SMALL_GROUP < n`` and at most ``BLOCK_POINTS`` distinct points: one
   Arrow-batched ``applyInPandas`` call per group runs the O(m log^2 m) NumPy
   kernel ``dominance_counts``.
3. larger groups (a hot source, or the whole table for an overall tau): the
   group is cut into value blocks on both coordinates (edges from
   ``percentile_approx``; every edge value is its own block, so a heavy value
   never inflates an interval block).  Pairs are split into
   same-a-block (A) + same-b-block (B) - same-both (C) + different-both (D);
   A, B, C are the same problem over the blocks and D over the block-count
   matrix, so each goes to the tier of its size: a block above the bound is cut
   again.  Single-value blocks contribute nothing to strict
   comparisons and are skipped, which removes value skew.

Counts are doubles: exact up to 2**53 pairs, and they never overflow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_GROUP = 64
BLOCK_POINTS = 2_000_000     # distinct points per kernel call (~100 MB of arrays)
HISTOGRAM = 1 << 20          # weights by block and rank that a kernel holds at once
FAN_OUT = 1024               # blocks that a level cuts a group into at most
BROADCAST_KEYS = 200_000      # key rows we are willing to broadcast
BROADCAST_EDGE_VALUES = 2_000_000


# ---------------------------------------------------------------------------
# NumPy kernel
# ---------------------------------------------------------------------------

def dominance_counts(a, b, w, t):
    """Weighted ordered-pair counts between data (t=1) and query (t=0)
    points; t=2 marks a point that is both.

    Returns ``(d1, lt, gt)`` with
    ``d1 = sum w_d w_q [a_d < a_q]``,
    ``lt = sum w_d w_q [a_d < a_q][b_d < b_q]``,
    ``gt = sum w_d w_q [a_d < a_q][b_d > b_q]``.
    ``b`` may be None (1-D only).
    """
    a = np.asarray(a, dtype=np.float64)
    w = np.asarray(w, dtype=np.float64)
    t = np.asarray(t, dtype=np.int64)
    if b is not None:
        b = np.asarray(b, dtype=np.float64)
    both = t == 2
    if both.all():
        return _self_counts(a, b, w)
    if both.any():
        a = np.concatenate([a, a[both]])
        w = np.concatenate([w, w[both]])
        if b is not None:
            b = np.concatenate([b, b[both]])
        t = np.concatenate([np.where(both, 1, t), np.zeros(int(both.sum()), dtype=np.int64)])
    isq = t == 0
    if a.size == 0 or not isq.any() or isq.all():
        return 0.0, 0.0, 0.0
    # Order by a; on equal a queries come first, so equal-a data never counts.
    order = np.lexsort((~isq, a))
    ws = w[order]
    qs = isq[order]
    dw = np.where(qs, 0.0, ws)
    before = np.cumsum(dw) - dw
    d1 = float(np.dot(ws[qs], before[qs]))
    if b is None:
        return d1, 0.0, 0.0
    _, rb = np.unique(b[order], return_inverse=True)
    rb = rb.astype(np.int64)
    radix = int(rb.max()) + 2
    m = ws.size
    idx = np.arange(m, dtype=np.int64)
    lt = 0.0
    le = 0.0
    s = 1
    # Bottom-up merge levels: at level s every position pair (i < j) meets
    # exactly once with i in the left and j in the right half of a block.
    while s < m:
        blk = idx // (2 * s)
        right = ((idx // s) & 1).astype(bool)
        left_data = ~right & ~qs
        right_q = right & qs
        if left_data.any() and right_q.any():
            kl = blk[left_data] * radix + rb[left_data]
            o = np.argsort(kl, kind="stable")
            ks = kl[o]
            cw = np.concatenate(([0.0], np.cumsum(ws[left_data][o])))
            base = blk[right_q] * radix
            rq = rb[right_q]
            lo = np.searchsorted(ks, base, "left")
            hi_lt = np.searchsorted(ks, base + rq, "left")
            hi_le = np.searchsorted(ks, base + rq, "right")
            wq = ws[right_q]
            lt += float(np.dot(wq, cw[hi_lt] - cw[lo]))
            le += float(np.dot(wq, cw[hi_le] - cw[lo]))
        s *= 2
    return d1, lt, d1 - le


def _self_counts(a, b, w):
    """``dominance_counts`` when every point is both data and query (the
    concordance case), without duplicating points: sort once by (a, b);
    pairs i < j then have a_i <= a_j, the equal-a pairs are counted in closed
    form and b-inversions are counted across merge levels."""
    if a.size < 2:
        return 0.0, 0.0, 0.0
    if b is None:
        b = np.zeros_like(a)
    # sort by (a, b) and collapse repeated points, so equal-a groups have
    # distinct b
    o = np.lexsort((b, a))
    a, b, w = a[o], b[o], w[o]
    new = np.ones(a.size, dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    w = np.bincount(np.cumsum(new) - 1, weights=w)
    a, b = a[new], b[new]
    tot = w.sum()
    start_a = np.ones(a.size, dtype=bool)
    start_a[1:] = a[1:] != a[:-1]
    ga = np.cumsum(start_a) - 1
    wa = np.bincount(ga, weights=w)
    sq = np.bincount(ga, weights=w * w)
    d1 = float((tot * tot - np.dot(wa, wa)) / 2)
    tie_lt = float(((wa * wa) - sq).sum() / 2)      # equal a, b_i < b_j
    _, rb = np.unique(b, return_inverse=True)
    rb = rb.ravel().astype(np.int64)
    radix = int(rb.max()) + 2
    m = a.size
    lt_all = 0.0
    gt_all = 0.0
    # ``perm`` lists positions sorted by (position // s, rank of b); each
    # level reads its left halves already sorted and merges two sorted runs
    # for the next level (linear for a stable sort), instead of re-sorting.
    # Blocks of an eighth of the values of b are compared by histograms.
    perm = np.arange(m, dtype=np.int64)
    s = 1
    while s < m and 8 * s < radix:
        sub = perm // s
        is_right = (sub & 1).astype(bool)
        L = perm[~is_right]
        R = perm[is_right]
        ks = (L // (2 * s)) * radix + rb[L]
        cw = np.concatenate(([0.0], np.cumsum(w[L])))
        base = (R // (2 * s)) * radix
        rq = rb[R]
        lo = np.searchsorted(ks, base, "left")
        hi_lt = np.searchsorted(ks, base + rq, "left")
        hi_le = np.searchsorted(ks, base + rq, "right")
        end = np.searchsorted(ks, base + radix, "left")
        wq = w[R]
        lt_all += float(np.dot(wq, cw[hi_lt] - cw[lo]))
        gt_all += float(np.dot(wq, cw[end] - cw[hi_le]))
        both_keys = np.concatenate((ks, base + rq))
        perm = np.concatenate((L, R))[np.argsort(both_keys, kind="stable")]
        s *= 2
    if s < m:
        lt, gt = _block_counts(w, rb, s, radix)
        lt_all, gt_all = lt_all + lt, gt_all + gt
    return d1, lt_all - tie_lt, gt_all


def _block_counts(w, rb, s, radix):
    """Pairs of different blocks of ``s`` positions, the first position's rank
    below and above: weights by rank of all blocks before, a bounded number of
    blocks at a time."""
    before, lt, gt = np.zeros(radix), 0.0, 0.0
    step = max(1, HISTOGRAM // radix) * s
    for a in range(0, len(w), step):
        own, weight = rb[a:a + step], w[a:a + step]
        n = -(-len(own) // s)
        here = np.bincount(np.arange(len(own)) // s * radix + own, weights=weight, minlength=n * radix).reshape(n, radix)
        seen = np.cumsum(np.concatenate((before[None], here)), axis=0)
        upto = np.cumsum(seen[:-1], axis=1)
        held = here != 0
        upto_held, weights = upto[held], here[held]
        lt += float(np.dot(weights, upto_held - seen[:-1][held]))
        gt += float((here.sum(axis=1) * upto[:, -1]).sum() - np.dot(weights, upto_held))
        before = seen[-1]
    return lt, gt


def difference_cut(g: np.ndarray, width: float, strict: bool = False) -> np.ndarray:
    """The largest double ``v`` with ``g - v >= width`` (``> width`` if
    strict), the difference rounded as IEEE subtraction does.  Subtraction is
    monotone, so the values at least ``width`` below ``g`` are those up to the
    cut, whatever the rounding; found by halving the ordered doubles."""
    g = np.asarray(g, dtype=np.float64)

    def flip(i):                    # order of doubles <-> order of integers
        return i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))

    lo = flip(np.full(g.shape, -np.inf).view(np.int64))
    hi = flip((g + 0.0).view(np.int64))
    for _ in range(64):
        mid = (lo >> 1) + (hi >> 1) + (lo & hi & 1)
        diff = g - flip(mid).view(np.float64)
        far = diff > width if strict else diff >= width
        lo, hi = np.where(far, mid, lo), np.where(far, hi, mid)
    return flip(lo).view(np.float64)


def partners(values: np.ndarray, g: np.ndarray, width: float, strict: bool = False) -> np.ndarray:
    """For each ``g`` the number of the ascending ``values`` with ``g - v >=
    width`` (``> width`` if strict), compared by that difference itself."""
    low, high = np.zeros(len(g), dtype=np.int64), np.full(len(g), len(values), dtype=np.int64)
    with np.errstate(invalid="ignore"):
        for _ in range(len(values).bit_length()):
            mid = (low + high) // 2
            diff = g - values[np.minimum(mid, len(values) - 1)]
            far = (diff > width if strict else diff >= width) & (low < high)
            low, high = np.where(far, mid + 1, low), np.where(far, high, mid)
    return low


def above(b: np.ndarray, asked: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (k, x, strict) of ``asked`` the number and sum of the first ``k[i]``
    of ``b`` that are above ``x[i]`` (or equal, unless strict): a prefix is at
    most one block of each power of two, and the blocks of a size are sorted."""
    n = len(b)
    order = np.argsort(b, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    at = [np.searchsorted(b[order], x, "right" if strict else "left") for _, x, strict in asked]
    out = [(np.zeros(len(k), dtype=np.int64), np.zeros(len(k))) for k, _, _ in asked]
    perm, s = np.arange(n), 1
    while s <= n:
        key = perm // s * n + rank[perm]
        upto = np.concatenate(([0.0], np.cumsum(b[perm])))
        for (k, _, _), r, (count, total) in zip(asked, at, out):
            ask = np.flatnonzero(k // s & 1)
            block = k[ask] // s - 1
            low, high = np.searchsorted(key, block * n + r[ask]), (block + 1) * s
            count[ask] += high - low
            total[ask] += upto[high] - upto[low]
        s *= 2
        perm = perm[np.argsort(perm // s * n + rank[perm], kind="stable")]
    return out


def cut_column(c: str, width: float, strict: bool = False, above: bool = False):
    """``difference_cut`` of a column; ``above``: the next double after it."""
    @F.pandas_udf(T.DoubleType())
    def cut(g: pd.Series) -> pd.Series:
        v = difference_cut(g.to_numpy(dtype=np.float64, na_value=np.nan), width, strict)
        return pd.Series(np.nextafter(v, np.inf) if above else v)
    return cut(F.col(c).cast("double"))


def _kernel_fn(out_keys, use_b):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d1, lt, gt = dominance_counts(pdf["a"].to_numpy(),
                                      pdf["b"].to_numpy() if use_b else None,
                                      pdf["w"].to_numpy(), pdf["t"].to_numpy())
        row = {k: [pdf[k].iloc[0]] for k in out_keys}
        row.update(d1=[d1], lt=[lt], gt=[gt])
        return pd.DataFrame(row)
    return run


def _counts_schema(df: DataFrame, keys) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("d1", "lt", "gt")])


def maybe_broadcast(df: DataFrame, n_rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast only a side whose row count has been measured and is small."""
    return F.broadcast(df) if n_rows <= limit else df


# ---------------------------------------------------------------------------
# Spark-side dominance over weighted points
# ---------------------------------------------------------------------------

def dominance(pts: DataFrame, keys, use_b: bool = True,
              block_points: int | None = None) -> DataFrame:
    """``pts``: ``keys + [a, b, w, t]``.  Returns ``keys + [d1, lt, gt]`` per
    group (groups with no point are absent)."""
    keys = list(keys)
    block_points = block_points or BLOCK_POINTS
    if not use_b:
        pts = pts.withColumn("b", F.lit(0.0))
    pts = pts.select(*keys, F.col("a").cast("double").alias("a"),
                     F.col("b").cast("double").alias("b"),
                     F.col("w").cast("double").alias("w"), F.col("t").cast("int").alias("t"))
    schema = _counts_schema(pts, keys)
    sizes = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    small_lim = min(SMALL_GROUP, block_points)
    n_mid, n_big, max_m = sizes.agg(
        F.count_if(F.col("_m") > small_lim), F.count_if(F.col("_m") > block_points),
        F.max("_m")).first()
    if not n_mid:
        return _dominance_small(pts, keys)
    mid_keys = sizes.filter(F.col("_m") > small_lim).select(*keys)
    out = _dominance_small(pts.join(maybe_broadcast(mid_keys, n_mid), keys, "left_anti"), keys)
    if n_mid > n_big:
        mid = pts.join(maybe_broadcast(mid_keys, n_mid), keys, "left_semi")
        if n_big:
            big_keys = sizes.filter(F.col("_m") > block_points).select(*keys)
            mid = mid.join(maybe_broadcast(big_keys, n_big), keys, "left_anti")
        out = out.unionByName(mid.groupBy(*keys).applyInPandas(_kernel_fn(keys, use_b), schema))
    if n_big:
        big_keys = maybe_broadcast(sizes.filter(F.col("_m") > block_points).select(*keys), n_big)
        big_pts = pts.join(big_keys, keys, "left_semi")
        out = out.unionByName(_decomposed(big_pts, keys, int(n_big), int(max_m), use_b, block_points))
    return out


def _dominance_small(pts: DataFrame, keys) -> DataFrame:
    """Tier 1 of ``dominance``: groups of at most SMALL_GROUP points, looped
    over as a bounded array by higher-order functions (JVM side)."""
    g = pts.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "w", "t")).alias("_a"))

    def over_pairs(cond: str) -> F.Column:
        # ordered pairs (data x, query y); t=2 is both data and query
        return F.expr(
            "aggregate(_a, 0D, (acc, x) -> acc + aggregate(_a, 0D, (acc2, y) -> acc2 + "
            f"IF(x.t <> 0 AND y.t <> 1 AND x.a < y.a AND {cond}, x.w * y.w, 0D)))")
    return g.select(*keys, over_pairs("true").alias("d1"), over_pairs("x.b < y.b").alias("lt"),
                    over_pairs("x.b > y.b").alias("gt"))


def _with_block(df: DataFrame, col: str, edges: str, k: int, out: str) -> DataFrame:
    """``out``: 2j for the open interval below edge j, 2j + 1 for the edge value
    itself; the edges (at most ``k``, ascending) are searched by halving."""
    strides = ", ".join(str(1 << i) for i in reversed(range(k.bit_length())))
    below = F.expr(f"aggregate(array({strides}), 0, (p, s) -> IF(get({edges}, p + s - 1) < {col}, p + s, p))")
    df = df.withColumn(out, below)
    return df.withColumn(out, F.lit(2) * F.col(out) + F.coalesce(F.get(edges, F.col(out)) == F.col(col), F.lit(False)).cast("int"))


def _decomposed(pts, keys, n_big, max_m, use_b, block_points):
    """Counts of groups of more than ``block_points`` points.  A block that is
    still too large is a group of its own and cut again, so no kernel call
    holds more, whatever the size of the group.  Where b has at most FAN_OUT
    values in every group, each value is a block of its own: no two values of b
    share a block, and the parts of b are not needed."""
    k = int(min(FAN_OUT, max(2, 2 * math.ceil(max_m / block_points))))
    fracs = [i / k for i in range(1, k)]
    acc = max(10_000, 20 * k)
    n_edges_b, cut_b = k, use_b
    edges = pts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("a", fracs, acc)).alias("_ea"))
    if use_b:
        held = pts.select(*keys, "b").distinct()
        most = held.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= FAN_OUT:
            n_edges_b, cut_b = most, False
            edges_b = held.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("_eb"))
        else:
            edges_b = pts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("b", fracs, acc)).alias("_eb"))
        edges = edges.join(edges_b, keys)
    edges = maybe_broadcast(edges, n_big * (k + n_edges_b) // 2, BROADCAST_EDGE_VALUES)
    ba, bb = f"_ba{len(keys)}", f"_bb{len(keys)}"        # one pair of names a level
    p = _with_block(pts.join(edges, keys), "a", "_ea", k, ba)
    p = _with_block(p, "b", "_eb", n_edges_b, bb) if use_b else p.withColumn(bb, F.lit(0))
    p = p.drop("_ea", *(["_eb"] if use_b else [])).persist(StorageLevel.MEMORY_AND_DISK)

    def counts(df, by):
        return dominance(df, keys + by, use_b, block_points).select(*keys, "d1", "lt", "gt")

    even_a = F.col(ba) % 2 == 0
    even_b = F.col(bb) % 2 == 0
    parts = [counts(p.filter(even_a), [ba])]
    if cut_b:
        parts.append(counts(p.filter(even_b), [bb]).withColumn("d1", F.lit(0.0)))
        c = counts(p.filter(even_a & even_b), [ba, bb])
        parts.append(c.select(*keys, F.lit(0.0).alias("d1"), (-F.col("lt")).alias("lt"),
                              (-F.col("gt")).alias("gt")))
    cells = p.groupBy(*keys, ba, bb, "t").agg(F.sum("w").alias("w")).select(
        *keys, F.col(ba).cast("double").alias("a"), F.col(bb).cast("double").alias("b"),
        "w", "t")
    parts.append(counts(cells, []))
    allp = parts[0]
    for q in parts[1:]:
        allp = allp.unionByName(q)
    return allp.groupBy(*keys).agg(F.sum("d1").alias("d1"), F.sum("lt").alias("lt"),
                                   F.sum("gt").alias("gt"))


# ---------------------------------------------------------------------------
# Group routing
# ---------------------------------------------------------------------------

def _with_key(df: DataFrame, keys):
    keys = list(keys)
    if keys:
        return df, keys, False
    return df.withColumn("_all", F.lit(0)), ["_all"], True


def _split_by_size(df: DataFrame, keys, small: int):
    """(rows of groups with n <= small, rows of larger groups).  The set of
    large keys is measured before it is broadcast."""
    return split_tiers(df, keys, small, None)[:2]


def split_tiers(df: DataFrame, keys, small: int, bound: int | None):
    """(rows of groups with n <= small, rows of those up to ``bound``, rows of
    larger ones); None for a tier without groups, ``bound`` None: no third tier.
    The groups are counted once: the keys of large ones are kept."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > small).persist(StorageLevel.MEMORY_AND_DISK)
    above_bound = F.lit(False) if bound is None else F.col("_n") > bound
    n_large, n_huge = large.agg(F.count(F.lit(1)), F.count_if(above_bound)).first()
    if n_large == 0:
        large.unpersist()
        return df, None, None

    def of(n, which):
        return maybe_broadcast(large.filter(which).select(*keys), n)

    mid = df.join(of(n_large - n_huge, ~above_bound), keys, "left_semi") if n_large > n_huge else None
    huge = df.join(of(n_huge, above_bound), keys, "left_semi") if n_huge else None
    return df.join(of(n_large, F.lit(True)), keys, "left_anti"), mid, huge


def _nan_to_null(c: str):
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def concordance(df: DataFrame, keys, gold: str, preds, small: int = SMALL_GROUP,
                few_groups: bool = False) -> DataFrame:
    """Kendall tau-b of each prediction column against ``gold`` per group.

    Returns ``keys + [signal, n, s, tx, ty, tau]`` for groups with n >= 2:
    ``s`` = concordant - discordant pairs, ``tx``/``ty`` = pairs tied in the
    prediction / in gold.  ``tau`` is null (SciPy's NaN) when either side has
    a null in the group or is constant.
    """
    preds = list(preds)
    df, keys, synth = _with_key(df, keys)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    base = df.select(*keys, _nan_to_null(gold).alias("_y"),
                     *[_nan_to_null(p).alias(f"_p{i}") for i, p in enumerate(preds)])
    if synth or few_groups:
        # a handful of (usually large) groups, e.g. an overall tau
        out = _concordance_few(base, keys, preds)
    else:
        small_rows, large_rows = _split_by_size(base, keys, small)
        out = _concordance_small(small_rows, keys, preds)
        if large_rows is not None:
            out = out.unionByName(_concordance_large(large_rows, keys, preds))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    den = (n0 - F.col("tx")) * (n0 - F.col("ty"))
    raw = F.col("s") / F.sqrt(den)
    # clip to [-1, 1] with when: greatest/least would turn a null s into +-1
    tau = F.when(den > 0, F.when(raw > 1.0, F.lit(1.0)).when(raw < -1.0, F.lit(-1.0)).otherwise(raw))
    out = out.filter(F.col("n") >= 2).withColumn("tau", tau)
    return out.drop("_all") if synth else out


def _concordance_small(rows, keys, preds):
    g = rows.groupBy(*keys).agg(
        F.collect_list(F.struct("_y", *[f"_p{i}" for i in range(len(preds))])).alias("_a"))
    # one traversal of the pairs accumulates every signal's concordance sum,
    # tie count and count of pairs touching a null, plus the gold tie count
    # (a struct accumulator; it never holds a null, the null count decides)
    fields = ["ty"] + [f for i in range(len(preds)) for f in (f"s{i}", f"tx{i}", f"nb{i}")]
    zero = "named_struct(" + ", ".join(f"'{f}', 0D" for f in fields) + ")"
    step = ["'ty', c.ty + IF(_a[i]._y = e._y, 1D, 0D)"]
    for i in range(len(preds)):
        step.append(f"'s{i}', c.s{i} + coalesce(signum(_a[i]._p{i} - e._p{i}) * signum(_a[i]._y - e._y), 0D)")
        step.append(f"'tx{i}', c.tx{i} + IF(_a[i]._p{i} = e._p{i}, 1D, 0D)")
        step.append(f"'nb{i}', c.nb{i} + IF(_a[i]._p{i} IS NULL OR e._p{i} IS NULL OR "
                    "_a[i]._y IS NULL OR e._y IS NULL, 1D, 0D)")
    acc = (f"aggregate(sequence(0, size(_a) - 1), {zero}, (o, i) -> "
           f"aggregate(slice(_a, i + 2, size(_a)), o, (c, e) -> named_struct({', '.join(step)})))")
    wide = g.select(*keys, F.size("_a").cast("long").alias("n"), F.expr(acc).alias("_c"))
    # then unpivot: the grouped arrays are built and walked once however
    # many signals there are
    stack = ", ".join(f"'{p}', IF(_c.nb{i} > 0, CAST(NULL AS DOUBLE), _c.s{i}), _c.tx{i}"
                      for i, p in enumerate(preds))
    return wide.select(*keys, "n", F.col("_c.ty").alias("ty"),
                       F.expr(f"stack({len(preds)}, {stack}) AS (signal, s, tx)")) \
        .select(*keys, "signal", "n", "s", "tx", "ty")


def _tie_pairs(v: np.ndarray) -> float:
    _, c = np.unique(v, return_counts=True)
    c = c.astype(np.float64)
    return float((c * (c - 1) / 2).sum())


def _direct_fn(gk):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["_x"].to_numpy(dtype=np.float64, na_value=np.nan)
        y = pdf["_y"].to_numpy(dtype=np.float64, na_value=np.nan)
        bad = np.isnan(x) | np.isnan(y)
        row = {k: [pdf[k].iloc[0]] for k in gk}
        row["n"] = [int(len(pdf))]
        if bad.any():
            row.update(s=[None], tx=[0.0], ty=[0.0])
        else:
            _, lt, gt = _self_counts(x, y, np.ones(x.size))
            row.update(s=[lt - gt], tx=[_tie_pairs(x)], ty=[_tie_pairs(y)])
        return pd.DataFrame(row)
    return run


def _concordance_few(rows, keys, preds):
    """Few groups (an overall tau): when every group fits one kernel call,
    ship its rows once to the kernel, which also counts ties and nulls;
    otherwise collapse ties and take the general path."""
    gk = keys + ["signal"]
    stack = ", ".join(f"'{p}', _p{i}" for i, p in enumerate(preds))
    long = rows.select(*keys, "_y", F.expr(f"stack({len(preds)}, {stack}) AS (signal, _x)"))
    largest = long.groupBy(*gk).count().agg(F.max("count")).first()[0] or 0
    if largest > BLOCK_POINTS:
        return _concordance_large(rows, keys, preds)
    schema = T.StructType([long.schema[k] for k in gk] + [
        T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()),
        T.StructField("tx", T.DoubleType()), T.StructField("ty", T.DoubleType())])
    return long.groupBy(*gk).applyInPandas(_direct_fn(gk), schema)


def _concordance_large(rows, keys, preds):
    gk = keys + ["signal"]
    stack = ", ".join(f"'{p}', _p{i}" for i, p in enumerate(preds))
    long = rows.select(*keys, "_y", F.expr(f"stack({len(preds)}, {stack}) AS (signal, _x)"))
    counts = long.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_x").isNull() | F.col("_y").isNull()).alias("_nulls"))
    # the collapsed points feed four consumers (two tie counts, sizes, kernel)
    pts = long.dropna(subset=["_x", "_y"]).groupBy(*gk, "_x", "_y").agg(
        F.count(F.lit(1)).cast("double").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
    tie_p = pts.groupBy(*gk, "_x").agg(F.sum("w").alias("c")).groupBy(*gk).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("tx"))
    tie_g = pts.groupBy(*gk, "_y").agg(F.sum("w").alias("c")).groupBy(*gk).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("ty"))
    dom = dominance(pts.select(*gk, F.col("_x").alias("a"), F.col("_y").alias("b"), "w",
                               F.lit(2).alias("t")), gk)
    s = F.when(F.col("_nulls") == 0, F.col("lt") - F.col("gt"))
    return (counts.join(dom, gk, "left").join(tie_p, gk, "left").join(tie_g, gk, "left")
            .select(*gk, "n", s.alias("s"), F.coalesce("tx", F.lit(0.0)).alias("tx"),
                    F.coalesce("ty", F.lit(0.0)).alias("ty")))


def band_agreement(df: DataFrame, keys, gold: str, pred: str, tol: float,
                   small: int = SMALL_GROUP) -> DataFrame:
    """Pairs of a group classified by gold difference ``dg`` and prediction
    difference ``dp``: ``tie`` if ``|dg| < tol``; else ``agree`` if dp has the
    sign of dg, else ``disagree`` (a predicted tie is a miss).
    Rows with a null on either side are left out.  Returns
    ``keys + [n, agree, disagree, tie]``."""
    df, keys, synth = _with_key(df, keys)
    base = df.select(*keys, _nan_to_null(gold).alias("_g"), _nan_to_null(pred).alias("_p"))
    base = base.dropna()
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    small_rows, large_rows = _split_by_size(base, keys, small)
    tol_s = repr(float(tol))
    g = small_rows.groupBy(*keys).agg(F.collect_list(F.struct("_g", "_p")).alias("_a"))
    # one traversal counts ties and agreements (rows are null-free here)
    tie_c = f"abs(_a[i]._g - e._g) < {tol_s}"
    agree_c = (f"NOT ({tie_c}) AND ((_a[i]._g - e._g > 0 AND _a[i]._p - e._p > 0) OR "
               "(_a[i]._g - e._g < 0 AND _a[i]._p - e._p < 0))")
    acc = ("aggregate(sequence(0, size(_a) - 1), named_struct('tie', 0D, 'agree', 0D), (o, i) -> "
           "aggregate(slice(_a, i + 2, size(_a)), o, (c, e) -> named_struct("
           f"'tie', c.tie + IF({tie_c}, 1D, 0D), 'agree', c.agree + IF({agree_c}, 1D, 0D))))")
    out = g.select(*keys, F.size("_a").cast("long").alias("n"), F.expr(acc).alias("_c")) \
        .select(*keys, "n", F.col("_c.tie").alias("tie"), F.col("_c.agree").alias("agree"))
    out = out.withColumn("disagree", F.col("n") * (F.col("n") - 1) / 2 - F.col("tie") - F.col("agree"))
    if large_rows is not None:
        out = out.unionByName(_band_large(large_rows, keys, tol))
    out = out.select(*keys, "n", "agree", "disagree", "tie")
    return out.drop("_all") if synth else out


def _band_large(rows, keys, tol):
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # near = above the cut of "at least tol below", the rule of the small tier
    data = rows.select(*keys, (-F.col("_g")).alias("a"), F.col("_p").alias("b"), F.lit(1).alias("t"))
    qry = rows.groupBy(*keys, "_g", "_p").agg(F.count(F.lit(1)).alias("w")).select(
        *keys, (-cut_column("_g", float(tol))).alias("a"), F.col("_p").alias("b"), F.lit(0).alias("t"), "w")
    pts1 = data.groupBy(*keys, "a", "b", "t").agg(F.count(F.lit(1)).alias("w")).unionByName(qry)
    r1 = dominance(pts1, keys).select(*keys, F.col("d1").alias("_near"), F.col("lt").alias("_nlt"))
    pts2 = rows.groupBy(*keys, F.col("_p").alias("a")).agg(F.count(F.lit(1)).alias("w")) \
        .withColumn("t", F.lit(2)).withColumn("b", F.lit(0.0))
    r2 = dominance(pts2, keys, use_b=False).select(*keys, F.col("d1").alias("_plt"))
    j = n.join(r1, keys, "left").join(r2, keys, "left").fillna(0.0, ["_near", "_nlt", "_plt"])
    nontie = F.col("n") * F.col("n") - F.col("_near")
    agree = F.col("_plt") - F.col("_nlt")
    return j.select(*keys, F.col("n").cast("long").alias("n"), agree.alias("agree"),
                    (nontie - agree).alias("disagree"),
                    (F.col("n") * (F.col("n") - 1) / 2 - nontie).alias("tie"))
