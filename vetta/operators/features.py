"""Feature columns for blending and learning: text lengths, language
indicators, cross-signal terms, per-source context, error-span and vector
features, speech rate, and the assembled feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.functions import text as T
from vetta.functions import vectors as V
from vetta.operators.rank import nan_to_null

DOC_STATS = ("mean", "std", "min", "max")
MIN_DURATION = 0.1      # seconds; floor of the speech-rate denominator
SPAN_COLUMNS = ("error_count", "error_severity", "error_confidence")


def text_features(df: DataFrame, src: str = "src_text", tgt: str = "tgt_text") -> DataFrame:
    out = df.withColumn("src_word_count", T.word_count(src)) \
        .withColumn("tgt_word_count", T.word_count(tgt)) \
        .withColumn("length_ratio", T.ratio_floor1("tgt_word_count", "src_word_count")) \
        .withColumn("src_char_count", T.char_count(src)) \
        .withColumn("tgt_char_count", T.char_count(tgt)) \
        .withColumn("char_ratio", T.ratio_floor1("tgt_char_count", "src_char_count"))
    return out


def lp_indicators(df: DataFrame, col: str = "tgt_lang") -> DataFrame:
    return df.withColumn("is_zh", T.indicator(col, "zh")).withColumn("is_de", T.indicator(col, "de"))


def cross_features(df: DataFrame, signals) -> DataFrame:
    cols = []
    for i, a in enumerate(signals):
        for b in signals[i + 1:]:
            cols += [(F.col(a) - F.col(b)).alias(f"{a}_minus_{b}"), (F.col(a) * F.col(b)).alias(f"{a}_times_{b}")]
    return df.select("*", *cols)


def doc_context(df: DataFrame, signals, key: str = "doc_id") -> DataFrame:
    """Per-source mean, sample std, min and max of each signal on every row,
    plus the deviation from the source mean.  Aggregated with a partial
    (map-side) aggregation and joined back on the key, so a hot source is
    split by the join's skew handling instead of landing in one window task."""
    aggs = []
    for s in signals:
        v = nan_to_null(s)      # a NaN counts as missing, not as the source's mean
        aggs += [F.avg(v).alias(f"{s}_doc_mean"), F.stddev_samp(v).alias(f"{s}_doc_std"),
                 F.min(v).alias(f"{s}_doc_min"), F.max(v).alias(f"{s}_doc_max")]
    stats = df.groupBy(key).agg(*aggs)
    out = df.join(stats, key, "left")
    for s in signals:
        out = out.withColumn(f"{s}_doc_dev", nan_to_null(s) - F.col(f"{s}_doc_mean"))
    return out


def span_features(spans: DataFrame, col: str = "spans") -> DataFrame:
    return spans.withColumn("error_count", V.span_count(col).cast("double")) \
        .withColumn("error_severity", V.span_severity(col)) \
        .withColumn("error_confidence", V.span_confidence(col))


def vector_features(df: DataFrame, col: str = "embedding", prefix: str = "emb_") -> DataFrame:
    return df.withColumn(f"{prefix}norm", V.norm(col)).withColumn(f"{prefix}mean", V.mean(col)) \
        .withColumn(f"{prefix}std", V.std_pop(col))


def mean_pool(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of each key, as ``key, n, pooled``.
    Exploded to (key, position) and averaged: partial aggregation, no group
    of vectors is ever held in one place."""
    ex = df.select(key, F.posexplode(col).alias("_pos", "_v"))
    per = ex.groupBy(key, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"),
                                      F.count(F.lit(1)).alias("_n"))
    return per.groupBy(key).agg(
        F.max("_n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("pooled"))


def cosine_to_pool(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """Cosine of each vector with the pooled mean of its key (one pooled
    vector per key, broadcast-sized: keys x dimension)."""
    pool = mean_pool(df, key, col).select(key, "pooled")
    return df.join(pool, key).withColumn("cosine", V.cosine(col, "pooled")).drop("pooled")


def speech_rate(df: DataFrame, frames: str = "frames", rate: str = "sample_rate",
                text: str = "src_text") -> DataFrame:
    dur = F.col(frames).cast("double") / F.col(rate).cast("double")
    return df.withColumn("audio_duration", dur).withColumn(
        "words_per_sec", T.word_count(text) / F.greatest(F.col("audio_duration"), F.lit(MIN_DURATION)))


def cap_frames(frames, max_sec: float, sample_rate: int = 16000):
    return F.least(F.col(frames) if isinstance(frames, str) else frames, F.lit(int(max_sec * sample_rate)))


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """NaN and null -> 0.0 (Spark keeps NaN apart from null)."""
    return df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def build_features(df: DataFrame, signals, spans: DataFrame | None = None,
                   speech: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, list]:
    """The feature table: signals, text features (when text is present),
    language indicators, cross-signal terms, per-source context, span and
    speech features when given; missing values are 0.  Returns
    ``(table, feature_names)``."""
    # the context first: its join moves rows, which are narrower before other terms
    out = doc_context(df, signals, key)
    context = [c for c in out.columns if c not in df.columns]
    names = list(signals)
    if "src_text" in df.columns and "tgt_text" in df.columns:
        out = text_features(out)
        names += ["src_word_count", "tgt_word_count", "length_ratio", "src_char_count",
                  "tgt_char_count", "char_ratio"]
    if "tgt_lang" in df.columns:
        out = lp_indicators(out)
        names += ["is_zh", "is_de"]
    if len(signals) >= 2:
        out = cross_features(out, signals)
        names += [f"{a}_{op}_{b}" for i, a in enumerate(signals) for b in signals[i + 1:]
                  for op in ("minus", "times")]
    out = out.select(*[c for c in out.columns if c not in context], *context)
    for s in signals:
        names += [f"{s}_doc_{st}" for st in DOC_STATS] + [f"{s}_doc_dev"]
    if spans is not None:
        # error spans belong to a row; a table without row ids holds them by source
        on = "row_id" if "row_id" in spans.columns else key
        sp = span_features(spans).select(on, *SPAN_COLUMNS)
        out = out.join(sp, on, "left")
        names += list(SPAN_COLUMNS)
    if speech is not None:
        cols = [c for c in speech.columns if c != "row_id"]
        out = out.join(speech.select("row_id", *[F.col(c).alias(f"speech_{c}") for c in cols]),
                       "row_id", "left")
        names += [f"speech_{c}" for c in cols]
    return fill_zero(out, names), names
