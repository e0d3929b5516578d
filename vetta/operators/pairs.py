"""Within-source pairs.

Aggregates over pairs (tau, agreement, ranking accuracy) never build the
pairs: see ``pairstats``.  This module covers the pair *records* the
reference trains on - (better, worse, margin) for every same-source pair
whose gold gap exceeds 1.0 - without materialising the full pair set:

* ``preference_counts`` counts each source's pairs exactly (1-D dominance).
* ``sample_preference_pairs`` draws a seeded uniform sample of K pair
  indices without replacement from [0, C) by a keyed permutation (C = all
  pairs; all of them when C <= K) and resolves each index to its two rows: sources are laid out in
  order, each row i owns the block of indices of its partners (the rows of
  its source whose gold is more than 1.0 lower: a suffix of the source in
  descending gold order), and a bucketed equi-join maps indices to owners.
  Only K pairs ever exist as rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.operators import pairstats, sourceruns
from vetta.plans.ordered import positions_in_group, with_prefix_sum

MIN_GAP = 1.0          # a pair needs a gold gap strictly above this
PAIR_CAP = 50_000
SEED = 42
MARGIN = 0.01          # fixed ranking margin
MSE_WEIGHT = 0.3
EQUAL_GOLD = 1e-6      # gold gaps (0-1 scale) that the fixed-margin loss calls equal
INDEX_BUCKETS = 4096
PART_ROWS = 250_000    # rows of a partition of small sources
EXAMPLE_ROWS = 64      # first rows tried in one step of disagreement_examples


def doc_pair_summary(df: DataFrame, signals, gold: str = "score") -> DataFrame:
    """Per source and signal: rows, pairs, concordant minus discordant, pairs
    tied in the prediction and in gold (no pair rows)."""
    c = pairstats.concordance(df, ["doc_id"], gold, signals)
    return c.select("doc_id", "signal", "n", (F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"),
                    "s", F.col("tx").alias("tied_pred"), F.col("ty").alias("tied_gold"))


def partner_counts(df: DataFrame, gold: str = "score", gap: float = MIN_GAP) -> DataFrame:
    """Rows with ``_gn`` (source size), ``_dpos`` (place in descending gold
    order, ties by row_id) and ``_k`` (rows of the source with gold below
    gold - gap, i.e. the row's partners).

    Sources of at most SMALL_GROUP rows: one shuffle, counts from the bounded
    per-source array.  Larger sources: distributed positions (no source is
    ever collected whole)."""
    base = df.filter(F.col(gold).isNotNull() & F.col("doc_id").isNotNull()) \
        .withColumn("_g", F.col(gold).cast("double"))
    small, large = pairstats._split_by_size(base, ["doc_id"], pairstats.SMALL_GROUP)
    other = [c for c in base.columns if c != "doc_id"]
    arr = small.groupBy("doc_id").agg(F.collect_list(F.struct(*other)).alias("_a"))
    gap_s = repr(float(gap))
    per_row = F.expr(
        "transform(_a, x -> struct(x AS r, size(_a) AS n, "
        "size(filter(_a, e -> e._g > x._g OR (e._g = x._g AND e.row_id < x.row_id))) AS dpos, "
        f"size(filter(_a, e -> x._g - e._g > {gap_s})) AS k))")
    out = arr.select("doc_id", F.explode(per_row).alias("_x")).select(
        "doc_id", *[F.col(f"_x.r.{c}").alias(c) for c in other],
        F.col("_x.n").cast("long").alias("_gn"), F.col("_x.dpos").cast("long").alias("_dpos"),
        F.col("_x.k").cast("long").alias("_k"))
    if large is not None:
        out = out.unionByName(_partner_counts_large(large, gap))
    return out


def _partner_counts_large(base: DataFrame, gap: float) -> DataFrame:
    desc = positions_in_group(base.withColumn("_ng", -F.col("_g")), ["doc_id"], "_ng", ["row_id"]) \
        .withColumnRenamed("_gpos", "_dpos").drop("_ng")
    # union of rows (t=1) and thresholds (t=0), the first value that is not more
    # than gap below: thresholds sort before equal values, so the partners precede it
    keys = desc.select("doc_id", "row_id", "_g")
    u = keys.select("doc_id", "row_id", F.col("_g").alias("_v"), F.lit(1).alias("_t")).unionByName(
        keys.select("doc_id", "row_id", pairstats.cut_column("_g", float(gap), strict=True, above=True).alias("_v"),
                    F.lit(0).alias("_t")))
    pu = positions_in_group(u, ["doc_id"], "_v", ["_t", "row_id"]).filter(F.col("_t") == 0) \
        .select("doc_id", "row_id", F.col("_gpos").alias("_pu"))
    qa = positions_in_group(keys, ["doc_id"], "_g", ["row_id"]).select(
        "doc_id", "row_id", F.col("_gpos").alias("_qa"))
    k = pu.join(qa, ["doc_id", "row_id"]).select("doc_id", "row_id", (F.col("_pu") - F.col("_qa")).alias("_k"))
    return desc.join(k, ["doc_id", "row_id"]).select(
        "doc_id", *[c for c in base.columns if c != "doc_id"], F.col("_gn").cast("long").alias("_gn"),
        F.col("_dpos").cast("long").alias("_dpos"), F.col("_k").cast("long").alias("_k"))


def _arrays(rows: DataFrame, n_rows: int, values) -> DataFrame:
    """``doc_id`` and the array ``_a`` of the ``values`` of each small source, in
    partitions of a bounded number of rows."""
    n = sourceruns.partitions(rows, n_rows, PART_ROWS)
    return rows.repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(values).alias("_a"))


def _source_counts(gap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sort(pdf["g"].to_numpy())
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n": [len(g)], "n_pairs": [pairstats.partners(g, g, gap, strict=True).sum()]})
    return run


def preference_counts(df: DataFrame, gold: str = "score", gap: float = MIN_GAP) -> DataFrame:
    """Per source: rows and preference pairs (gold gap > ``gap``).  Small sources
    are bounded arrays, larger ones one kernel call each up to BLOCK_POINTS
    rows, beyond that weighted dominance counts."""
    base = df.select("doc_id", pairstats._nan_to_null(gold).alias("g")).dropna()
    few, mid, huge = pairstats.split_tiers(base, ["doc_id"], pairstats.SMALL_GROUP, pairstats.BLOCK_POINTS)
    pairs = F.expr(f"aggregate(_a, 0L, (c, x) -> c + size(filter(_a, e -> x - e > {float(gap)!r}D)))")
    out = _arrays(few, base.count(), "g").select("doc_id", F.size("_a").cast("long").alias("n"), pairs.alias("n_pairs"))
    if mid is not None:
        id_type = base.schema["doc_id"].dataType.simpleString()
        out = out.unionByName(mid.groupBy("doc_id").applyInPandas(_source_counts(gap), f"doc_id {id_type}, n long, n_pairs long"))
    return out if huge is None else out.unionByName(_preference_counts_large(huge, gap))


def _preference_counts_large(base: DataFrame, gap: float) -> DataFrame:
    held = base.groupBy("doc_id", F.col("g").alias("a")).agg(F.count(F.lit(1)).alias("w"))
    asked = held.select("doc_id", pairstats.cut_column("a", float(gap), strict=True, above=True).alias("a"), "w")
    pts = held.withColumn("t", F.lit(1)).unionByName(asked.withColumn("t", F.lit(0))) \
        .withColumn("b", F.lit(0.0))
    d = pairstats.dominance(pts, ["doc_id"], use_b=False)
    n = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(d, "doc_id", "left").select(
        "doc_id", "n", F.coalesce(F.col("d1"), F.lit(0.0)).cast("long").alias("n_pairs"))


def permutation_rounds(seed: int, rounds: int = 3) -> list[tuple[int, int]]:
    """Odd factor and summand of each round of ``permuted``."""
    h = [hashlib.md5(f"{seed}|{r}".encode()).hexdigest() for r in range(rounds)]
    return [(2 * int(x[:4], 16) + 1, int(x[8:15], 16)) for x in h]


def permuted(total: int, k: int, seed: int = SEED) -> np.ndarray:
    """The first ``k`` places of a keyed permutation of 0 .. total - 1, in order.

    On m-bit numbers a round multiplies by an odd number, adds, and xors the
    upper half into the lower one, so it loses nothing; places beyond ``total``
    are permuted again until they fall inside (cycle walking).  Any engine
    with 64-bit integers gets the same places."""
    bits = max(2, (total - 1).bit_length())
    mask, half = (1 << bits) - 1, (bits + 1) // 2

    def step(x: np.ndarray) -> np.ndarray:
        for a, c in permutation_rounds(seed):
            x = (x * a + c) & mask
            x = x ^ (x >> half)
        return x

    if k >= total:
        return np.arange(total)
    x = step(np.arange(k, dtype=np.int64))
    while (out := x >= total).any():
        x[out] = step(x[out])
    return x


def sample_preference_pairs(df: DataFrame, payload=("src_text", "tgt_text"), gold: str = "score",
                            k: int = PAIR_CAP, seed: int = SEED, gap: float = MIN_GAP) -> DataFrame:
    """Seeded uniform sample (without replacement) of ``k`` preference pairs,
    or all of them when there are at most ``k``.  Returns ``pair_index,
    doc_id, row_better, row_worse, <payload>_better, <payload>_worse,
    score_better, score_worse, margin`` with scores on a 0-1 scale."""
    spark = df.sparkSession
    payload = [c for c in payload if c in df.columns]
    rows = partner_counts(df.select("doc_id", "row_id", gold), gold, gap)
    owned = with_prefix_sum(rows, [F.col("doc_id"), F.col("_dpos")], "_k", "_off") \
        .persist()
    total = int(owned.agg(F.sum("_k")).first()[0] or 0)
    idx = permuted(total, min(k, total), seed).tolist()
    width = max(1, math.ceil(total / INDEX_BUCKETS))
    samples = spark.createDataFrame([(int(i), int(i) // width) for i in idx] or [(-1, -1)],
                                    "pair_index long, _b long")
    # each owner covers buckets floor(off/width) .. floor((off+k-1)/width):
    # at most rows + INDEX_BUCKETS bucket rows in total
    owners = owned.filter(F.col("_k") > 0).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_off") / width).cast("long"),
                                   F.floor((F.col("_off") + F.col("_k") - 1) / width).cast("long"))))
    hit = owners.join(F.broadcast(samples), "_b").filter(
        (F.col("pair_index") >= F.col("_off")) & (F.col("pair_index") < F.col("_off") + F.col("_k")))
    hit = hit.withColumn("_jpos", (F.col("_gn") - F.col("_k") + (F.col("pair_index") - F.col("_off")))
                         .cast("long"))
    better = hit.select("pair_index", "doc_id", "_jpos", F.col("row_id").alias("row_better"), F.col(gold).alias("_gb"))
    worse = owned.select("doc_id", F.col("_dpos").cast("long").alias("_jpos"),
                         F.col("row_id").alias("row_worse"), F.col(gold).alias("_gw"))
    # at most k sampled pairs: broadcast into the row table, and for the payload
    # into the table itself
    pairs = worse.join(F.broadcast(better), ["doc_id", "_jpos"])
    for side in ("better", "worse") if payload else ():
        held = df.select("doc_id", F.col("row_id").alias(f"row_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in payload])
        pairs = held.join(F.broadcast(pairs), ["doc_id", f"row_{side}"])
    return pairs.select(
        "pair_index", "doc_id", "row_better", "row_worse",
        *[x for c in payload for x in (f"{c}_better", f"{c}_worse")],
        (F.col("_gb") / 100.0).alias("score_better"), (F.col("_gw") / 100.0).alias("score_worse"),
        ((F.col("_gb") - F.col("_gw")) / 100.0).alias("margin"))


def pair_sums(df: DataFrame, pred: str, gold: str = "score", scale: float = 100.0, margin: float = MARGIN,
              gap: float = MIN_GAP, adaptive: bool = True, small: int = pairstats.SMALL_GROUP) -> DataFrame:
    """Sums over all same-source pairs whose gold differs by more than ``gap``:
    ``n_pairs``, ``hinge`` (of ``max(0, m - (p_better - p_worse))`` with ``m`` the
    margin, or half the scaled gold gap where that is larger and ``adaptive``),
    ``squares`` (mean of the two squared errors) and ``right`` (better row
    predicted higher).  Sources of at most ``small`` rows are looped over as
    bounded arrays, those up to BLOCK_POINTS take one kernel call; in larger ones
    every sum is a weighted dominance count, as the hinge is linear on each side
    of its kink."""
    base = df.select("doc_id", pairstats._nan_to_null(gold).alias("g"), pairstats._nan_to_null(pred).alias("p")).dropna()
    few, mid, huge = pairstats.split_tiers(base, ["doc_id"], small, pairstats.BLOCK_POINTS)
    m = f"greatest(0.5D * ((_a[i].g - e.g) / {scale!r}D), {margin!r}D)" if adaptive else f"{margin!r}D"
    err = f"(power({{0}}.p - {{0}}.g / {scale!r}D, 2))"
    step = (f"named_struct('n', c.n + 1, 'h', c.h + greatest(0D, {m} - (_a[i].p - e.p)), "
            f"'q', c.q + ({err.format('_a[i]')} + {err.format('e')}) / 2, 'r', c.r + IF(_a[i].p > e.p, 1D, 0D))")
    zero = "named_struct('n', 0D, 'h', 0D, 'q', 0D, 'r', 0D)"
    loop = (f"aggregate(sequence(0, size(_a) - 1), {zero}, (o, i) -> aggregate(_a, o, (c, e) -> "
            f"IF(_a[i].g - e.g > {gap!r}D, {step}, c)))")
    arrays = _arrays(few, base.count(), F.struct("g", "p"))
    out = arrays.select(F.expr(loop).alias("_c")).select("_c.n", "_c.h", "_c.q", "_c.r")
    if mid is not None:
        out = out.unionByName(mid.groupBy("doc_id").applyInPandas(_source_sums(scale, margin, gap, adaptive), "n double, h double, q double, r double"))
    if huge is not None:
        out = out.unionByName(_pair_sums_large(huge, scale, margin, gap, adaptive))
    total = [F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for c, name in
             (("n", "n_pairs"), ("h", "hinge"), ("q", "squares"), ("r", "right"))]
    return out.agg(*total)


def _source_sums(scale: float, margin: float, gap: float, adaptive: bool):
    """Kernel of ``pair_sums`` for one source.  In ascending gold order the partners
    of a row are the first rows, so each sum is one over prefixes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["g"].to_numpy()
        order = np.argsort(g, kind="stable")
        g, p = g[order], pdf["p"].to_numpy()[order]
        near = pairstats.partners(g, g, gap, strict=True)
        error = (p - g / scale) ** 2
        upto = np.concatenate(([0.0], np.cumsum(error)))
        value, moved = p - g / scale / 2, p + margin
        kink = 2 * margin * scale
        far = pairstats.partners(g, g, kink) if adaptive and kink > gap else near

        def excess(found, query):
            """Sum of how far the worse values exceed the better one."""
            count, total = found
            return float(np.where(count > 0, total - count * query, 0.0).sum())

        lower, = pairstats.above(p, [(near, p, False)])
        h = 0.0
        if not adaptive or kink > gap:
            first, *beyond = pairstats.above(moved, [(near, p, True), *([(far, p, True)] if adaptive else [])])
            h = excess(first, p) - sum(excess(x, p) for x in beyond)
        if adaptive:
            # where half the gap is the larger margin, p - s / 2 is compared instead
            h += excess(pairstats.above(value, [(far, value, True)])[0], value)
        n = float(near.sum())
        return pd.DataFrame({"n": [n], "h": [h], "q": [float((near * error + upto[near]).sum()) / 2], "r": [n - float(lower[0].sum())]})
    return run


def _pair_sums_large(rows: DataFrame, scale: float, margin: float, gap: float, adaptive: bool) -> DataFrame:
    """The sums of ``pair_sums`` for large sources, one row for each sum."""
    def dominated(value, wide: float, strict: bool, data_w, query_w, kind: str, sign: float, shift: float = 0.0):
        """Sum of data weight x query weight over pairs (worse = data, better =
        query) beyond the gap ``wide``; kind lt/gt also compares ``value`` (the
        worse one's moved up by ``shift``)."""
        one = rows.select("doc_id", "g", F.col("g").alias("a"), (value + F.lit(shift)).alias("b"), data_w.alias("w"), F.lit(1).alias("t"))
        two = rows.select("doc_id", "g", pairstats.cut_column("g", wide, strict=strict, above=True).alias("a"), value.alias("b"),
                          query_w.alias("w"), F.lit(0).alias("t"))
        got = pairstats.dominance(one.unionByName(two).drop("g"), ["doc_id"], use_b=kind != "d1")
        return got.select((F.col(kind) * F.lit(sign)).alias("v"))

    one, p, s = F.lit(1.0), F.col("p"), F.col("g") / scale
    error = F.pow(p - s, 2)

    def excess(value, wide, strict, shift, sign):
        """Sum of how far the worse value (moved up) exceeds the better one."""
        return [("h", dominated(value, wide, strict, value + F.lit(shift), one, "gt", sign, shift)),
                ("h", dominated(value, wide, strict, one, value, "gt", -sign, shift))]

    parts = [("n", dominated(p, gap, True, one, one, "d1", 1.0)), ("r", dominated(p, gap, True, one, one, "lt", 1.0)),
             ("q", dominated(p, gap, True, one, error, "d1", 0.5)), ("q", dominated(p, gap, True, error, one, "d1", 0.5)),
             *excess(p, gap, True, margin, 1.0)]
    if adaptive:
        # where half the gap is the larger margin, p - s / 2 is compared instead
        kink = 2 * margin * scale
        if kink > gap:
            parts += [*excess(p, kink, False, margin, -1.0), *excess(p - s / 2, kink, False, 0.0, 1.0)]
        else:
            parts = parts[:4] + excess(p - s / 2, gap, True, 0.0, 1.0)
    out = None
    for name, part in parts:
        row = part.agg(*[(F.coalesce(F.sum("v"), F.lit(0.0)) if c == name else F.lit(0.0)).alias(c) for c in "nhqr"])
        out = row if out is None else out.unionByName(row)
    return out


def pair_loss(df: DataFrame, pred: str, gold: str = "score", margin: float = MARGIN, mse_weight: float = MSE_WEIGHT,
              small: int = pairstats.SMALL_GROUP) -> DataFrame:
    """Ranking report over all preference pairs (gold on 0-100, predictions on
    0-1): adaptive-margin hinge, pair MSE, their weighted combination and
    ranking accuracy."""
    sums = pair_sums(df, pred, gold, margin=margin, small=small)
    n = F.when(F.col("n_pairs") > 0, F.col("n_pairs"))
    return sums.select(F.col("n_pairs").cast("long").alias("n_pairs"), (F.col("hinge") / n).alias("ranking_loss"),
                       (F.col("squares") / n).alias("mse_loss"), (F.col("right") / n).alias("rank_accuracy")) \
        .withColumn("loss", F.lit(mse_weight) * F.col("mse_loss") + F.lit(1 - mse_weight) * F.col("ranking_loss"))


def fixed_margin_loss(df: DataFrame, pred: str, gold: str = "score", margin: float = MARGIN,
                      mse_weight: float = MSE_WEIGHT, small: int = pairstats.SMALL_GROUP) -> DataFrame:
    """The same with a fixed margin over all same-source pairs of unequal gold
    (on the 0-1 scale, beyond 1e-6), and the MSE over rows."""
    unit = df.select("doc_id", (pairstats._nan_to_null(gold) / 100).alias("g01"), pairstats._nan_to_null(pred).alias("p01"))
    sums = pair_sums(unit, "p01", "g01", scale=1.0, margin=margin, gap=EQUAL_GOLD, adaptive=False, small=small)
    mse = unit.agg(F.avg(F.pow(F.col("p01") - F.col("g01"), 2))).scalar()
    n = F.when(F.col("n_pairs") > 0, F.col("n_pairs"))
    return sums.select(F.col("n_pairs").cast("long").alias("n_pairs"), (F.col("hinge") / n).alias("ranking_loss"),
                       mse.alias("mse_loss")) \
        .withColumn("loss", F.lit(mse_weight) * F.col("mse_loss")
                    + F.lit(1 - mse_weight) * F.coalesce("ranking_loss", F.lit(0.0)))


def disagreement_examples(df: DataFrame, signal: str, gold: str = "score", k: int = 5,
                          band: float = 1.0) -> DataFrame:
    """First ``k`` disagreeing same-source pairs in (source, row, row) order.
    Sources are chosen from per-source disagreement counts (no pairs).  Then
    each source's rows are tried as the first row of a pair a run at a time, in
    row order, until k pairs are found: a step joins at most ``EXAMPLE_ROWS``
    rows with the source, never the source with itself."""
    counts = pairstats.band_agreement(df, ["doc_id"], gold, signal, band)
    docs = counts.filter(F.col("disagree") > 0).select("doc_id").orderBy("doc_id").limit(k)
    rows = df.join(F.broadcast(docs), "doc_id").select("doc_id", "row_id", "tgt_system", F.col(gold).alias("g"),
                                                       F.col(signal).alias("p")).persist()
    dg, dp = F.col("a.g") - F.col("b.g"), F.col("a.p") - F.col("b.p")
    dis = (F.abs(dg) >= band) & ~(((dg > 0) & (dp > 0)) | ((dg < 0) & (dp < 0)))
    found, last = [], None
    schema = None
    while len(found) < k:
        order = rows.orderBy("doc_id", "row_id")
        if last is not None:
            order = rows.filter((F.col("doc_id") > last[0]) | ((F.col("doc_id") == last[0]) & (F.col("row_id") > last[1]))) \
                .orderBy("doc_id", "row_id")
        first = order.limit(EXAMPLE_ROWS)
        step = first.select("doc_id", "row_id").collect()       # at most EXAMPLE_ROWS keys
        pairs = rows.alias("b").join(F.broadcast(first).alias("a"), (F.col("a.doc_id") == F.col("b.doc_id"))
                                     & (F.col("a.row_id") < F.col("b.row_id")) & dis)
        best = pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.row_id").alias("row_i"), F.col("b.row_id").alias("row_j"),
                            F.col("a.tgt_system").alias("sys_i"), F.col("b.tgt_system").alias("sys_j"), dg.alias("gold_diff"),
                            dp.alias("pred_diff"))
        schema = best.schema
        if not step:
            break
        found += best.orderBy("doc_id", "row_i", "row_j").limit(k - len(found)).collect()
        last = max((r.doc_id, r.row_id) for r in step)
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, schema)


def epoch_order(df: DataFrame, epoch: int, key: str = "pair_index", seed: int = SEED,
                out: str = "position") -> DataFrame:
    """A fresh seeded order of rows for each training epoch: position in the
    order of ``md5(seed|epoch|key)`` (repeatable, engine-independent; a
    distributed sort, no single task holds the rows)."""
    from vetta.plans.ordered import with_position
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    return with_position(df.withColumn("_h", h), [F.col("_h"), F.col(key)], out).drop("_h")
