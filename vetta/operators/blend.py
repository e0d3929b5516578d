"""Document folds, weighted blending and weight search.

Folds come from a hash of the source id, so they are stateless, repeatable in
any engine and never split a source.  The weight search scores every
candidate weight vector in one pass: each candidate is one more blended
column, per-source tau is computed for all of them together, and
cross-validation reuses the same per-source table (train tau of fold f =
totals minus fold f).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.operators import pairstats, rank, sourceruns
from vetta.plans.ordered import with_position

SEED = 42
N_FOLDS = 5
GRID = (0.0, 0.25, 0.5, 0.75, 1.0)


def doc_fold(key: str = "doc_id", k: int = N_FOLDS, seed: int = SEED):
    """``first 8 hex digits of md5(seed|key)`` as an integer, modulo k."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("long"), F.lit(k))


def doc_folds(df: DataFrame, key: str = "doc_id", k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    return df.select(key).distinct().withColumn("fold", doc_fold(key, k, seed))


def balanced_folds(df: DataFrame, key: str = "doc_id", k: int = N_FOLDS) -> DataFrame:
    """Sources ordered by size (largest first, ties by id) and dealt to folds
    in a snake (0..k-1, k-1..0, ...), from a distributed row index: fold
    sizes differ by at most one source's rows per round."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    p = with_position(sizes, [F.desc("n"), F.asc(key)], "_p")
    rnd = F.floor(F.col("_p") / k)
    off = F.pmod(F.col("_p"), F.lit(k))
    return p.select(key, "n", F.when(rnd % 2 == 0, off).otherwise(F.lit(k - 1) - off).cast("long").alias("fold"))


def weighted_blend(signals, weights) -> F.Column:
    """``sum(w_i * s_i) / sum(w_i)``; a zero weight sum gives null."""
    tot = float(sum(weights))
    if tot == 0:
        return F.lit(None).cast("double")
    expr = None
    for s, w in zip(signals, weights):
        term = F.col(s) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr / F.lit(tot)


def blend_from_table(df: DataFrame, weights: DataFrame, signals, out: str = "ensemble_score") -> DataFrame:
    """Blend with a ``signal, weight`` table (read once on the driver: one
    number per signal)."""
    w = {r["signal"]: float(r["weight"]) for r in weights.collect()}
    if len(signals) == 1:
        return df.withColumn(out, F.col(signals[0]).cast("double"))
    return df.withColumn(out, weighted_blend(signals, [w.get(s, 1.0 / len(signals)) for s in signals]))


def candidate_grid(k: int, grid=GRID):
    """All weight vectors over ``grid`` with a non-zero sum, in a fixed order."""
    return [c for c in itertools.product(grid, repeat=k) if sum(c) > 0]


def _cand_name(i: int) -> str:
    return f"cand_{i:04d}"


PART_ROWS = 250_000        # rows of a partition of small sources
CHUNK = 32                 # candidates whose pair signs are in memory at once


def _small_kernel(read, candidates):
    """Sums of tau of every candidate over the small sources of a partition."""
    W = np.asarray(candidates, dtype=np.float64)
    tot = W.sum(axis=1)

    def run(batches):
        sums = {}
        for r in read(batches):
            s = sourceruns.signs(r)
            folds, fold = np.unique(r.fold, return_inverse=True)
            for c0 in range(0, len(W), CHUNK):
                Wc, tc = W[c0:c0 + CHUNK], tot[c0:c0 + CHUNK]
                # blended value per row, in the same operation order as the
                # Spark expression, then pair differences
                B = r.x[:, [0]] * Wc[:, 0]
                for k in range(1, r.x.shape[1]):
                    B = B + r.x[:, [k]] * Wc[:, k]
                B = B / tc
                sg = np.sign(r.difference(B))
                S = r.per_source(sg * s.gold[:, None])
                tx = r.per_source((sg == 0).astype(np.float64))
                den = (r.n_pairs[:, None] - tx) * (r.n_pairs - s.gold_ties)[:, None]
                ok = (den > 0) & s.whole[:, None]
                tau = np.where(ok, np.clip(S / np.sqrt(np.where(den > 0, den, 1.0)), -1.0, 1.0), 0.0)
                for i, f in enumerate(folds):
                    t, n = sums.setdefault(int(f), (np.zeros(len(W)), np.zeros(len(W), dtype=np.int64)))
                    t[c0:c0 + CHUNK] += tau[fold == i].sum(axis=0)
                    n[c0:c0 + CHUNK] += ok[fold == i].sum(axis=0)
        for f, (t, n) in sums.items():
            yield pd.DataFrame({"fold": np.int64(f), "cand": np.arange(len(W), dtype=np.int64), "sum_tau": t, "n_def": n})
    return run


def scored_rows(df: DataFrame, signals, gold: str = "score", fold_col: str | None = None) -> DataFrame:
    """``doc_id``, ``_y``, the signals and perhaps ``fold``, NaN read as null."""
    cols = ["doc_id", rank.nan_to_null(gold).alias("_y"),
            *[rank.nan_to_null(s).alias(s) for s in signals]]
    if fold_col:
        cols.append(F.col(fold_col).cast("long").alias("fold"))
    return df.filter(F.col("doc_id").isNotNull()).select(*cols)


class Sources:
    """Rows of small and of large sources of a frame, told apart once."""

    def __init__(self, df: DataFrame, signals, gold: str = "score", fold_col: str | None = None, small: int | None = None):
        base = scored_rows(df, signals, gold, fold_col)
        limit = pairstats.SMALL_GROUP if small is None else small
        sizes, n_rows, self.n_big = sourceruns.source_sizes(base, limit)
        self.signals, self.gold, self.folds = list(signals), gold, bool(fold_col)
        self.big, small = None, base
        if self.n_big:
            large = sizes.filter(F.col("_n") > limit).select("doc_id").persist()     # used twice
            keys = pairstats.maybe_broadcast(large, self.n_big)
            small = base.join(keys, "doc_id", "left_anti")
            self.big = base.join(keys, "doc_id", "left_semi").withColumnRenamed("_y", gold)
            self.parts = sourceruns.partitions(df, n_rows, PART_ROWS)
        self.small = sourceruns.small_sources(small, sourceruns.partitions(df, n_rows, PART_ROWS))
        self.read = functools.partial(sourceruns.runs, signals=self.signals)

    def persist(self) -> Sources:
        """For many passes over the pairs of all sources: the runs of the small ones,
        the points of the large ones and their pairs of blocks."""
        self.small, self.read = sourceruns.packed(self.small, self.signals).persist(), sourceruns.packed_runs
        self.kept = [self.small]
        if self.n_big:
            self.points = sourceruns.points(self.big.withColumnRenamed(self.gold, "_y"), self.signals).persist()
            self.pairs = sourceruns.source_pairs(self.points).persist()
            self.blocks = sourceruns.block_pairs(self.points, self.signals, self.parts).persist()
            self.kept += [self.points, self.pairs, self.blocks]
        return self

    def unpersist(self) -> None:
        for df in self.kept:
            df.unpersist()

    def tau_sums(self, candidates) -> DataFrame:
        """``fold, cand, sum_tau, n_def`` of the candidates."""
        out = self.small.mapInPandas(_small_kernel(self.read, candidates), "fold long, cand long, sum_tau double, n_def long")
        if self.n_big:
            t = candidate_doc_taus(self.big, self.signals, candidates, self.gold, ["fold"] if self.folds else [])
            t = t.withColumn("cand", F.regexp_extract("signal", r"(\d+)$", 1).cast("long"))
            fold = F.col("fold") if self.folds else F.lit(0).cast("long")
            out = out.unionByName(t.groupBy(fold.alias("fold"), "cand").agg(
                F.sum(F.coalesce("tau", F.lit(0.0))).alias("sum_tau"), F.count("tau").alias("n_def")))
        return out.groupBy("fold", "cand").agg(F.sum("sum_tau").alias("sum_tau"), F.sum("n_def").alias("n_def"))


def candidate_tau_sums(df: DataFrame, signals, candidates, gold: str = "score",
                       fold_col: str | None = None) -> DataFrame:
    """Per (fold, candidate): sum and count of defined per-source taus of the
    blended column.  Sources of at most SMALL_GROUP rows are scored by a
    vectorised kernel over streamed runs of pairs (all candidates at once,
    reduced in the task); larger sources take the exact general path.
    Returns ``fold, cand, sum_tau, n_def``."""
    return Sources(df, signals, gold, fold_col).tau_sums(candidates)


def candidate_doc_taus(df: DataFrame, signals, candidates, gold: str = "score", extra=()) -> DataFrame:
    """Per source and candidate: tau of the blended column against gold."""
    cols = [weighted_blend(signals, c).alias(_cand_name(i)) for i, c in enumerate(candidates)]
    wide = df.select("doc_id", gold, *extra, *cols)
    return rank.tau_by_group(wide, [_cand_name(i) for i in range(len(candidates))],
                             [*extra, "doc_id"], gold)


def _cand_table(spark, candidates, signals):
    return spark.createDataFrame(
        [(_cand_name(i), i, ",".join(f"{w:g}" for w in c), *map(float, c)) for i, c in enumerate(candidates)],
        "signal string, cand_order int, weights string, " + ", ".join(f"w_{s} double" for s in signals))


def weight_sweep(df: DataFrame, signals, grid=GRID, gold: str = "score") -> DataFrame:
    """Mean per-source tau of every grid candidate: ``weights, tau`` (0.0
    where no source has a defined tau)."""
    cands = candidate_grid(len(signals), grid)
    sums = candidate_tau_sums(df, signals, cands, gold).groupBy("cand").agg(
        F.sum("sum_tau").alias("s"), F.sum("n_def").alias("c"))
    ct = _cand_table(df.sparkSession, cands, signals)
    return ct.join(sums, ct.cand_order == sums.cand, "left").select(
        *ct.columns, F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(F.lit(0.0)).alias("tau"))


def best_weights(sweep: DataFrame) -> DataFrame:
    """Highest tau (compared at 9 places: scale-equivalent candidates tie up
    to summation order); the earliest candidate wins ties."""
    return sweep.orderBy(F.desc(F.round("tau", 9)), F.asc("cand_order")).limit(1)


def cv_ensemble(df: DataFrame, signals, k: int = N_FOLDS, grid=GRID, gold: str = "score",
                seed: int = SEED) -> DataFrame:
    """Cross-validated weights: for each fold the candidate with the best
    mean tau over the other folds' sources, and its tau on the fold's own
    sources.  One per-source tau table serves every fold."""
    cands = candidate_grid(len(signals), grid)
    per = candidate_tau_sums(df.withColumn("fold", doc_fold("doc_id", k, seed)), signals, cands, gold,
                             "fold").select("fold", F.col("cand").cast("int").alias("cand_order"),
                                            F.col("sum_tau").alias("fs"), F.col("n_def").alias("fc"))
    tot = per.groupBy("cand_order").agg(F.sum("fs").alias("ts"), F.sum("fc").alias("tc"))
    j = per.join(tot, "cand_order").withColumn(
        "train_tau", F.when(F.col("tc") - F.col("fc") > 0,
                            (F.col("ts") - F.col("fs")) / (F.col("tc") - F.col("fc")))
        .otherwise(F.lit(0.0))).withColumn(
        "val_tau", F.when(F.col("fc") > 0, F.col("fs") / F.col("fc")).otherwise(F.lit(0.0)))
    ct = _cand_table(df.sparkSession, cands, signals).drop("signal")
    j = j.join(F.broadcast(ct), "cand_order")
    # scale-equivalent candidates have equal taus up to summation order:
    # compare at 9 places, the earliest candidate wins ties
    best = j.groupBy("fold").agg(F.max_by(F.struct("weights", "train_tau", "val_tau", "cand_order",
                                                   *[f"w_{s}" for s in signals]),
                                          F.struct(F.round("train_tau", 9), -F.col("cand_order"))).alias("b"))
    return best.select("fold", "b.*").drop("cand_order")


def cv_predictions(df: DataFrame, folds: DataFrame, signals, k: int = N_FOLDS, seed: int = SEED,
                   out: str = "cv_ensemble_score") -> DataFrame:
    """Out-of-fold blended score: each row uses its fold's weights."""
    wcols = [f"w_{s}" for s in signals]
    r = df.withColumn("fold", doc_fold("doc_id", k, seed)).join(
        F.broadcast(folds.select("fold", *wcols)), "fold", "left")
    num = None
    for s, w in zip(signals, wcols):
        term = F.col(s) * F.col(w)
        num = term if num is None else num + term
    den = sum((F.col(w) for w in wcols[1:]), F.col(wcols[0]))
    return r.withColumn(out, F.when(den != 0, num / den)).drop(*wcols)


def oof_tau(df: DataFrame, pred: str, fold_col: str = "fold", gold: str = "score") -> DataFrame:
    """Per-source tau of one prediction, averaged within each fold, plus the
    mean over folds (fold = -1)."""
    t = rank.tau_by_group(df, [pred], [fold_col, "doc_id"], gold)
    per = t.groupBy(fold_col).agg(F.coalesce(F.avg("tau"), F.lit(0.0)).alias("tau"),
                                  F.count("tau").alias("n_docs"))
    mean = per.agg(F.lit(-1).cast("long").alias(fold_col), F.avg("tau").alias("tau"),
                   F.sum("n_docs").alias("n_docs"))
    return per.select(F.col(fold_col).cast("long").alias(fold_col), "tau", "n_docs").unionByName(mean)


def _mean_taus(df: DataFrame, signals, cands, gold: str) -> np.ndarray:
    """Mean per-source tau of each candidate (one Spark job for all)."""
    sums = candidate_tau_sums(df, signals, [tuple(map(float, c)) for c in cands], gold) \
        .groupBy("cand").agg(F.sum("sum_tau").alias("s"), F.sum("n_def").alias("c")).collect()
    out = np.zeros(len(cands))
    for r in sums:
        if r["c"]:
            out[int(r["cand"])] = r["s"] / r["c"]
    return out


def differential_evolution_weights(df: DataFrame, signals, generations: int = 100, popsize: int = 15,
                                   seed: int = SEED, mutation=(0.5, 1.0), recombination: float = 0.7,
                                   tol: float = 1e-6, gold: str = "score"):
    """Weights in [0, 1]^k maximising mean per-source tau by differential
    evolution (best/1/bin, dithered mutation, Latin-hypercube start).  Each
    generation's whole trial population is scored by one Spark job; the
    driver only keeps the k-vectors.  Returns ``(weights, tau)``."""
    rng = np.random.default_rng(seed)
    k = len(signals)
    npop = max(5, popsize * k)
    seg = (np.arange(npop)[:, None] + rng.random((npop, k))) / npop
    pop = np.column_stack([seg[rng.permutation(npop), j] for j in range(k)])
    fit = _mean_taus(df, signals, pop, gold)
    for _ in range(generations):
        best = pop[int(np.argmax(fit))]
        f = rng.uniform(*mutation)
        trials = np.empty_like(pop)
        for i in range(npop):
            r1, r2 = rng.choice([j for j in range(npop) if j != i], 2, replace=False)
            mutant = np.clip(best + f * (pop[r1] - pop[r2]), 0.0, 1.0)
            cross = rng.random(k) < recombination
            cross[rng.integers(k)] = True
            trials[i] = np.where(cross, mutant, pop[i])
        tf = _mean_taus(df, signals, trials, gold)
        better = tf >= fit
        pop[better], fit[better] = trials[better], tf[better]
        if np.std(fit) <= tol * abs(np.mean(fit)):
            break
    i = int(np.argmax(fit))
    return pop[i].tolist(), float(fit[i])
