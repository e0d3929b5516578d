"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key
of the operator inventory, each over whole driver tables (via the views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetta.operators import rank
from vetta.sources import views

SIG = views.SIGNALS


def kendall_per_source(spark, d):
    return rank.kendall_per_source(views.ratings(spark, d), SIG)


def kendall_per_lp(spark, d):
    return rank.kendall_per_lp(views.ratings(spark, d), SIG)


def kendall_overall(spark, d):
    return rank.kendall_overall(views.ratings(spark, d), SIG).select(
        "signal", "n", rank.r6("tau").alias("tau"))


def pearson_report(spark, d):
    r = views.ratings(spark, d).withColumn("lp", rank.lp_label())
    overall = rank.pearson(r, SIG).withColumn("lp", F.lit("all"))
    per_lp = rank.pearson(r, SIG, by=["lp"])
    return overall.unionByName(per_lp).select("lp", "signal", "n", rank.r6("pearson").alias("pearson"))


def soft_pairwise_accuracy(spark, d):
    r = views.ratings(spark, d)
    out = []
    for thr in (25.0, 10.0):
        out.append(rank.soft_pairwise_accuracy(r, SIG, threshold=thr)
                   .withColumn("threshold", F.lit(thr)))
    return out[0].unionByName(out[1]).select("threshold", "signal", rank.r6("spa").alias("spa"))


def evaluate_metric(spark, d):
    return rank.evaluate_metric(views.ratings(spark, d), SIG)


REGISTRY = {
    "kendall_per_source": kendall_per_source,
    "kendall_per_lp": kendall_per_lp,
    "kendall_overall": kendall_overall,
    "pearson_report": pearson_report,
    "soft_pairwise_accuracy": soft_pairwise_accuracy,
    "evaluate_metric": evaluate_metric,
}


# --- profiles -----------------------------------------------------------------

from vetta.functions import text as T  # noqa: E402
from vetta.operators import profile  # noqa: E402


def _round_doubles(df):
    return df.select(*[rank.r6(f.name).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def score_profile(spark, d):
    return _round_doubles(profile.score_profile(views.ratings(spark, d)))


def score_histogram(spark, d):
    r = views.ratings(spark, d)
    a = profile.score_histogram(r, "score").withColumn("column", F.lit("score"))
    b = profile.score_histogram(r, "sig_c_score").withColumn("column", F.lit("sig_c_score"))
    return a.unionByName(b)


def value_counts(spark, d):
    r = views.ratings(spark, d)
    return profile.value_counts(r, {"lp": T.lp_label(), "domain": F.col("domain"),
                                    "tgt_system": F.col("tgt_system"),
                                    "src_text_system": F.col("src_text_system")})


def stats_by_lp(spark, d):
    r = views.ratings(spark, d).withColumn("lp", T.lp_label())
    return _round_doubles(profile.stats_by(r, ["lp"]))


def stats_by_system(spark, d):
    return _round_doubles(profile.stats_by(views.ratings(spark, d), ["tgt_system"]))


def stats_grouping_sets(spark, d):
    """Score statistics for the grouping sets (lp), (system), (lp, system) in
    one pass: rows are exploded once per set under a surrogate group key, so
    one distributed sort gives every median."""
    r = views.ratings(spark, d).withColumn("lp", T.lp_label())
    none = F.lit(None).cast("string")
    sets = F.array(
        F.struct(F.lit("lp").alias("grouping"), F.col("lp").alias("lp"), none.alias("tgt_system")),
        F.struct(F.lit("system").alias("grouping"), none.alias("lp"), F.col("tgt_system").alias("tgt_system")),
        F.struct(F.lit("lp_system").alias("grouping"), F.col("lp").alias("lp"),
                 F.col("tgt_system").alias("tgt_system")))
    ex = r.select("score", F.explode(sets).alias("_s")).select("score", "_s.*")
    ex = ex.withColumn("_gk", F.concat_ws("|", "grouping", F.coalesce("lp", F.lit("")),
                                          F.coalesce("tgt_system", F.lit(""))))
    st = profile.stats_by(ex, ["_gk"])
    names = ex.groupBy("_gk").agg(F.first("grouping").alias("grouping"), F.first("lp").alias("lp"),
                                  F.first("tgt_system").alias("tgt_system"))
    return _round_doubles(st.join(names, "_gk").drop("_gk"))


def doc_structure(spark, d):
    return _round_doubles(profile.doc_structure(views.ratings(spark, d)))


def length_stats(spark, d):
    return _round_doubles(profile.length_stats(views.segments(spark, d)))


def score_examples(spark, d):
    dq = views.doc_quality(spark, d).withColumn("row_id", F.col("doc_id"))
    return profile.score_examples(dq, "score", "row_id", text_cols=("text",))


def head_docs(spark, d):
    return profile.head_rows(views.ratings(spark, d), "row_id", 20, ("doc_id",))


REGISTRY.update({
    "score_profile": score_profile,
    "score_histogram": score_histogram,
    "value_counts": value_counts,
    "stats_by_lp": stats_by_lp,
    "stats_by_system": stats_by_system,
    "stats_grouping_sets": stats_grouping_sets,
    "doc_structure": doc_structure,
    "length_stats": length_stats,
    "score_examples": score_examples,
    "head_docs": head_docs,
})


# --- sources, projections, filters, sinks --------------------------------------

from vetta.operators import select as S  # noqa: E402
from vetta.sources import segments as SEG  # noqa: E402
from vetta.sources import sinks  # noqa: E402


def scan_prune(spark, d):
    return SEG.read_segments(spark, [f"{d}/lineitem.parquet", f"{d}/missing-part.parquet"],
                             ["l_orderkey", "l_quantity", "audio", "l_returnflag"])


def _union(spark, d):
    syn = S.rescale(views.synthetic_split(spark, d), 100.0)
    return S.union_splits(views.train_split(spark, d), syn)


def rescale_union(spark, d):
    return _union(spark, d).select("split", "row_id", "doc_id", "src_lang", "tgt_lang",
                                   rank.r6("score").alias("score"))


def lp_filter(spark, d):
    return S.lp_filter(_union(spark, d)).select("split", "row_id", "tgt_lang")


def lp_complement(spark, d):
    return S.lp_complement(_union(spark, d)).select("split", "row_id", "tgt_lang")


def subset_counts(spark, d):
    return S.subset_counts(views.train_split(spark, d), views.synthetic_split(spark, d),
                           synth_tgts=("de",))


def clean_text(spark, d):
    return T.clean_text(views.segments_left(spark, d)).select("row_id", "src_text", "tgt_text")


def null_to_empty(spark, d):
    s = views.segments_left(spark, d)
    return s.select("row_id", T.null_to_empty("tgt_text").alias("tgt_text"),
                    F.col("tgt_text").isNull().alias("was_null"))


def prompt_format(spark, d):
    s = views.segments(spark, d)
    return s.select("row_id", T.prompt_source_candidate("src_text", "tgt_text").alias("prompt"),
                    T.prompt_separator("src_text", "tgt_text").alias("pair_text"))


def lang_code(spark, d):
    dq = views.doc_quality(spark, d)
    return dq.select("doc_id", "lang", T.lang_code("lang", T.DEFAULT_SRC_CODE).alias("src_code"),
                     T.lang_code("lang", T.DEFAULT_TGT_CODE).alias("tgt_code"))


def clip_invert(spark, d):
    r = views.ratings(spark, d).withColumn("error", F.col("score") / 3 - 5)
    return r.select("row_id", rank.r6("error").alias("error"),
                    rank.r6(T.clip_invert("error")).alias("quality"))


def side_features(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    labels = views.table(spark, d, "labels")        # some documents have none
    side = labels.select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    joined, _ = SEG.attach_side_features(docs, side, prefix="side_")
    return joined.select("row_id", "n_chars", "side_quality", "side_toxic")


def weights_default(spark, d):
    r = views.ratings(spark, d)
    sigs = SEG.signal_columns(r.columns)
    saved = rank.pearson(r, ["sig_a_score", "sig_b_score"]).select(
        "signal", F.col("pearson").alias("weight"))
    return SEG.weights_with_default(sigs, saved).select("signal", rank.r6("weight").alias("weight"))


def train_csv_rows(spark, d):
    dq = views.doc_quality(spark, d).select(F.col("text").alias("src_text"),
                                            F.col("source").alias("tgt_text"), "score")
    return sinks.training_rows(dq).select("src", "mt", rank.r6("score").alias("score"))


def _final(spark, d):
    r = views.ratings(spark, d)
    sigs = SEG.signal_columns(r.columns)
    return r.withColumn("final_score", sum(F.col(s) for s in sigs) / len(sigs)), sigs


def submission_lines(spark, d):
    r, _ = _final(spark, d)
    return sinks.score_lines(r, "final_score", "row_id")


def submission_stats(spark, d):
    r, sigs = _final(spark, d)
    m = sinks.run_metadata(r, "final_score", sigs, "weighted", "2024-01-01 00:00:00")
    return m.select("team", "system", F.concat_ws(",", "signals").alias("signals"), "method",
                    "timestamp", "n_test_samples",
                    *[rank.r6(F.col("score_stats")[k]).alias(k) for k in ("mean", "std", "min", "max")])


REGISTRY.update({
    "scan_prune": scan_prune, "rescale_union": rescale_union, "lp_filter": lp_filter,
    "lp_complement": lp_complement, "subset_counts": subset_counts, "clean_text": clean_text,
    "null_to_empty": null_to_empty, "prompt_format": prompt_format, "lang_code": lang_code,
    "clip_invert": clip_invert, "side_features": side_features,
    "weights_default": weights_default, "train_csv_rows": train_csv_rows,
    "submission_lines": submission_lines, "submission_stats": submission_stats,
})


# --- error analysis -------------------------------------------------------------------

from vetta.functions import vectors as V  # noqa: E402
from vetta.operators import analyse as A  # noqa: E402


def _detail(spark, d):
    return A.per_source_detail(views.ratings(spark, d), SIG)


def per_source_detail(spark, d):
    return _round_doubles(_detail(spark, d))


def tau_distribution(spark, d):
    return _round_doubles(A.tau_distribution(_detail(spark, d)))


def worst_sources(spark, d):
    return _round_doubles(A.worst_sources(_detail(spark, d), signals=SIG).select(
        "signal", "rank", "doc_id", "tau", "n_systems", "gold_range", "pred_range",
        "src_lang", "tgt_lang"))


def worst_drilldown(spark, d):
    r = views.ratings(spark, d)
    worst = A.worst_sources(_detail(spark, d), k=3, signals=["sig_a_score"])
    return _round_doubles(A.worst_drilldown(r, worst, "sig_a_score"))


def _detail9(spark, d):
    """The detail with 9-place values: equal ones that came by different float
    paths must tie in both engines."""
    detail = _detail(spark, d)
    return detail.select("signal", *[F.round(c, 9).alias(c) if t == "double" else F.col(c)
                                     for c, t in detail.dtypes if c != "signal"])


def spearman_props(spark, d):
    return _round_doubles(A.spearman_props(_detail9(spark, d)).drop("pvalue"))


def spearman_pvalues(spark, d):
    """r with its two-sided p (the t distribution has no SQL function)."""
    return _round_doubles(A.spearman_props(_detail9(spark, d)))


def lp_tau_breakdown(spark, d):
    return _round_doubles(A.lp_tau_breakdown(_detail(spark, d)))


def gold_quintiles(spark, d):
    return _round_doubles(A.gold_quintiles(views.ratings(spark, d), SIG))


def pair_agreement(spark, d):
    return _round_doubles(A.pair_agreement(views.ratings(spark, d), SIG))


def compression_ratio(spark, d):
    return _round_doubles(A.compression_ratio(views.ratings(spark, d), SIG))


def signal_summary(spark, d):
    return _round_doubles(A.signal_summary(views.ratings(spark, d), SIG))


def cross_signal(spark, d):
    return _round_doubles(A.cross_signal(views.ratings(spark, d), SIG))


def signal_disagreement(spark, d):
    return _round_doubles(A.signal_disagreement(views.ratings(spark, d), SIG))


def system_means(spark, d):
    return _round_doubles(rank.system_means(views.ratings(spark, d), SIG))


def leaderboard(spark, d):
    return _round_doubles(rank.leaderboard(views.ratings(spark, d), SIG))


def best_signal(spark, d):
    return _round_doubles(rank.best_signal(rank.leaderboard(views.ratings(spark, d), SIG)))


FEATURES_V = ["emb_norm", "emb_mean", "emb_std"]


def _vector_features(spark, d):
    v = views.vectors(spark, d)
    return v.select("vec_id", "label", V.norm("embedding").alias("emb_norm"),
                    V.mean("embedding").alias("emb_mean"), V.std_pop("embedding").alias("emb_std"))


def feature_tau(spark, d):
    f = _vector_features(spark, d)
    return rank.kendall_overall(f, FEATURES_V, gold="label").select(
        F.col("signal").alias("feature"), "n", rank.r6("tau").alias("tau"))


REGISTRY.update({
    "per_source_detail": per_source_detail, "tau_distribution": tau_distribution,
    "worst_sources": worst_sources, "worst_drilldown": worst_drilldown,
    "spearman_props": spearman_props, "spearman_pvalues": spearman_pvalues, "lp_tau_breakdown": lp_tau_breakdown,
    "gold_quintiles": gold_quintiles, "pair_agreement": pair_agreement,
    "compression_ratio": compression_ratio, "signal_summary": signal_summary,
    "cross_signal": cross_signal, "signal_disagreement": signal_disagreement,
    "system_means": system_means, "leaderboard": leaderboard, "best_signal": best_signal,
    "feature_tau": feature_tau,
})


# --- pairs ------------------------------------------------------------------------------

from vetta.operators import pairs as PR  # noqa: E402
from vetta.plans.ordered import with_position  # noqa: E402


def doc_pairs(spark, d):
    return _round_doubles(PR.doc_pair_summary(views.ratings(spark, d), SIG))


def preference_pairs(spark, d):
    return PR.preference_counts(views.ratings(spark, d))


def _sampled(spark, d):
    r = views.ratings(spark, d)
    return PR.sample_preference_pairs(r, payload=("tgt_system", "sig_a_score"))


def pair_cap(spark, d):
    return _round_doubles(_sampled(spark, d))


def pair_loss(spark, d):
    return _round_doubles(PR.pair_loss(views.ratings(spark, d), "sig_a_score"))


def pair_loss_fixed(spark, d):
    return _round_doubles(PR.fixed_margin_loss(views.ratings(spark, d), "sig_a_score"))


def pair_loss_decimal(spark, d):
    """Over sources on both sides of the array limit, gold with two decimals."""
    return _round_doubles(PR.pair_loss(views.decimal_ratings(spark, d), "sig_a_score"))


def preference_pairs_decimal(spark, d):
    return PR.preference_counts(views.decimal_ratings(spark, d))


def pair_agreement_decimal(spark, d):
    return _round_doubles(A.pair_agreement(views.decimal_ratings(spark, d), ["sig_a_score"]))


def disagreement_examples(spark, d):
    return _round_doubles(PR.disagreement_examples(views.ratings(spark, d), "sig_a_score"))


def seeded_shuffle(spark, d, seed: int = 42):
    r = views.ratings(spark, d).select("row_id", "doc_id")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("row_id")))
    return with_position(r.withColumn("_key", key), [F.col("_key")], "position").drop("_key")


REGISTRY.update({
    "doc_pairs": doc_pairs, "preference_pairs": preference_pairs, "pair_cap": pair_cap,
    "pair_loss": pair_loss, "pair_loss_fixed": pair_loss_fixed, "pair_loss_decimal": pair_loss_decimal,
    "preference_pairs_decimal": preference_pairs_decimal, "pair_agreement_decimal": pair_agreement_decimal,
    "disagreement_examples": disagreement_examples,
    "seeded_shuffle": seeded_shuffle,
})


# --- features ----------------------------------------------------------------------------

from vetta.operators import features as FE  # noqa: E402

TEXT_FEATURES = ["src_word_count", "tgt_word_count", "length_ratio", "src_char_count",
                 "tgt_char_count", "char_ratio"]


def text_features(spark, d):
    return _round_doubles(FE.text_features(views.segments(spark, d)).select("row_id", *TEXT_FEATURES))


def cross_features(spark, d):
    r = views.ratings(spark, d)
    out = FE.cross_features(r, SIG)
    return _round_doubles(out.select("row_id", *[c for c in out.columns if "_minus_" in c or "_times_" in c]))


def doc_context(spark, d):
    out = FE.doc_context(views.ratings(spark, d), SIG)
    return _round_doubles(out.select("row_id", *[c for c in out.columns if "_doc_" in c]))


def span_features(spark, d):
    return _round_doubles(FE.span_features(views.spans(spark, d)).select("doc_id", *FE.SPAN_COLUMNS))


def vector_features(spark, d):
    return _round_doubles(FE.vector_features(views.vectors(spark, d)).select(
        "vec_id", "emb_norm", "emb_mean", "emb_std"))


def mean_pool(spark, d):
    p = FE.mean_pool(views.vectors(spark, d), "label")
    return _round_doubles(p.select("label", "n", F.posexplode("pooled").alias("dim", "value")))


def cosine(spark, d):
    return _round_doubles(FE.cosine_to_pool(views.vectors(spark, d), "label").select("vec_id", "label", "cosine"))


def speech_rate(spark, d):
    return _round_doubles(FE.speech_rate(views.audio_meta(spark, d)).select(
        "row_id", "frames", "audio_duration", "words_per_sec"))


def build_features(spark, d):
    table, names = FE.build_features(views.ratings(spark, d), SIG, spans=views.spans(spark, d))
    return _round_doubles(table.select("row_id", *names))


REGISTRY.update({
    "text_features": text_features, "cross_features": cross_features, "doc_context": doc_context,
    "span_features": span_features, "vector_features": vector_features, "mean_pool": mean_pool,
    "cosine": cosine, "speech_rate": speech_rate, "build_features": build_features,
})


# --- folds, blending, weight search ----------------------------------------------------------

from vetta.operators import blend as BL  # noqa: E402
from vetta.operators import weights as WT  # noqa: E402


def doc_folds(spark, d):
    return BL.doc_folds(views.ratings(spark, d))


def balanced_folds(spark, d):
    return BL.balanced_folds(views.ratings(spark, d))


def weighted_ensemble(spark, d):
    r = views.ratings(spark, d)
    w = SEG.weights_with_default(SIG, rank.pearson(r, ["sig_a_score", "sig_b_score"]).select(
        "signal", F.col("pearson").alias("weight")))
    return _round_doubles(BL.blend_from_table(r, w, SIG).select("row_id", "ensemble_score"))


def weight_sweep(spark, d):
    return _round_doubles(BL.weight_sweep(views.ratings(spark, d), SIG).select("weights", "tau"))


def cv_ensemble(spark, d):
    return _round_doubles(BL.cv_ensemble(views.ratings(spark, d), SIG))


def oof_tau(spark, d):
    r = views.ratings(spark, d).withColumn("fold", BL.doc_fold())
    return _round_doubles(BL.oof_tau(r, "sig_a_score"))


def cv_scores(spark, d):
    """Out-of-fold blended scores: each row by its fold's weights."""
    r = views.ratings(spark, d)
    return _round_doubles(BL.cv_predictions(r, BL.cv_ensemble(r, SIG), SIG).select("row_id", "fold", "cv_ensemble_score"))


def cv_weights(spark, d):
    """Average weights and mean held-out tau of the cross-validated search."""
    folds = BL.cv_ensemble(views.ratings(spark, d), SIG)
    return _round_doubles(folds.agg(*[F.avg(f"w_{s}").alias(f"w_{s}") for s in SIG], F.avg("val_tau").alias("mean_tau")))


def final_score(spark, d):
    """Submission assembly: signals by suffix, weights from the grid search
    (what the search writes is what the blend reads), blend, order."""
    r = views.ratings(spark, d)
    sigs = SEG.signal_columns(r.columns)
    best = BL.best_weights(BL.weight_sweep(r, sigs))
    w = best.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"w_{s}").alias("weight"))
                                         for s in sigs])).alias("x")).select("x.*")
    return _round_doubles(BL.blend_from_table(r, w, sigs, "final_score").select("row_id", "final_score"))


def weight_lines(spark, d):
    """The best mean tau along each weight, the others at 1, and its interval."""
    return _round_doubles(WT.line_optima(views.ratings(spark, d), SIG))


def weight_search(spark, d):
    return _round_doubles(WT.search(views.ratings(spark, d), SIG))


def cv_weight_search(spark, d):
    return _round_doubles(WT.cross_validated(views.ratings(spark, d), SIG))


REGISTRY.update({
    "weight_lines": weight_lines, "weight_search": weight_search, "cv_weight_search": cv_weight_search,
    "doc_folds": doc_folds, "balanced_folds": balanced_folds, "weighted_ensemble": weighted_ensemble,
    "weight_sweep": weight_sweep, "cv_ensemble": cv_ensemble, "cv_scores": cv_scores, "cv_weights": cv_weights, "oof_tau": oof_tau,
    "final_score": final_score,
})


# --- learning and scoring ------------------------------------------------------------------------

from vetta.operators import learn as LN  # noqa: E402
from vetta.operators import scorer as SC  # noqa: E402
from vetta.operators import trees as TR  # noqa: E402


# a round is several passes over all folds: fewer and longer steps, on smaller
# trees, than the library's default
GBT = TR.Params(rounds=12, rate=0.4, leaves=15, patience=6)


def gbt_oof(spark, d):
    table, names = FE.build_features(views.ratings(spark, d), SIG)
    preds, _ = LN.gbt_oof(table, names, params=GBT)
    return _round_doubles(preds)


def isotonic_oof(spark, d):
    return _round_doubles(LN.isotonic_oof(views.ratings(spark, d), "sig_a_score"))


def ridge_stack(spark, d):
    preds, _ = LN.ridge_oof(views.ratings(spark, d), SIG)
    return _round_doubles(preds)


def pairwise_ranker(spark, d):
    scored, _ = LN.all_pairs_ranker(views.ratings(spark, d), SIG)
    return _round_doubles(scored.select("row_id", "ranker_score"))


def pairwise_ranker_decimal(spark, d):
    """Over sources on both sides of the array limit; the row's own order beside the signal."""
    r = views.decimal_ratings(spark, d).withColumn("length_score", F.length("row_id").cast("double"))
    scored, _ = LN.all_pairs_ranker(r, ["sig_a_score", "length_score"])
    return _round_doubles(scored.select("row_id", "ranker_score"))


def batch_scorer(spark, d):
    return _round_doubles(SC.score_with(views.segments(spark, d), SC.length_ratio_scorer,
                                        ["src_text", "tgt_text"], "lexical_score"))


def merge_signal(spark, d):
    scores = SC.score_with(views.segments_left(spark, d), SC.length_ratio_scorer,
                           ["src_text", "tgt_text"], "lexical_score")
    merged, _ = SC.merge_signal(views.segments(spark, d), scores)
    return _round_doubles(merged.select("row_id", "lexical_score"))


REGISTRY.update({
    "gbt_oof": gbt_oof, "isotonic_oof": isotonic_oof, "ridge_stack": ridge_stack,
    "pairwise_ranker": pairwise_ranker, "pairwise_ranker_decimal": pairwise_ranker_decimal, "batch_scorer": batch_scorer, "merge_signal": merge_signal,
})


def per_source_pvalue(spark, d):
    return _round_doubles(A.per_source_pvalues(views.ratings(spark, d), SIG))


REGISTRY["per_source_pvalue"] = per_source_pvalue


# --- the same operators over the events matrix and the labelled documents -------------

def kendall_per_source_events(spark, d):
    """A10 over the complete user x event-type matrix."""
    return rank.kendall_per_source(views.user_matrix(spark, d), ["sig_k_score"])


def spa_events(spark, d):
    """A14 over the events matrix (five systems)."""
    return rank.soft_pairwise_accuracy(views.user_matrix(spark, d), ["sig_k_score"]) \
        .select("signal", rank.r6("spa").alias("spa"))


def kendall_overall_labels(spark, d):
    """A9 with null gold: unlabelled documents are left out (P12)."""
    dq = views.doc_quality(spark, d).withColumn("len_score", F.col("n_chars").cast("double"))
    return rank.kendall_overall(dq, ["len_score"]).select("signal", "n", rank.r6("tau").alias("tau"))


REGISTRY.update({
    "kendall_per_source_events": kendall_per_source_events, "spa_events": spa_events,
    "kendall_overall_labels": kendall_overall_labels,
})
