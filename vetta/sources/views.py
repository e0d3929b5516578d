"""Segment-table views derived from the driver's parquet tables.

Each view is a lazy DataFrame over ``spark.read.parquet``; only the columns a
view needs are selected, so Catalyst prunes the scan (``ReadSchema``) and any
later filter is pushed into it.  The DuckDB twins live in ``vetta.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Synthetic-system count and severity codes of the fixture spec.
N_SYSTEMS = 8
SEVERITY_CODES = {"A": "minor", "N": "major", "R": "critical"}
OTHER_SEVERITY_TAX = 0.08


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sys_no() -> Column:
    return F.col("l_suppkey") % N_SYSTEMS


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment table with a gold ``score`` and three signals, one row per
    lineitem.  ``row_id`` is unique; ``doc_id`` groups rows of one order."""
    li = table(spark, sf_dir, "lineitem")
    sysn = _sys_no()
    open_line = F.col("l_linestatus") == "O"
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("SYS"), sysn.cast("string")).alias("tgt_system"),
        F.lit("en").alias("src_lang"),
        F.when(open_line, F.lit("de")).otherwise(F.lit("zh")).alias("tgt_lang"),
        F.col("l_returnflag").alias("domain"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("human")).otherwise(F.lit("asr"))
         .alias("src_text_system"),
        (F.col("l_quantity") * F.lit(1.4) + sysn * 4).alias("score"),
        (F.col("l_quantity") / 50 + F.lit(4.0) * F.col("l_tax")).alias("sig_a_score"),
        (F.col("l_quantity") / 100 + F.col("l_extendedprice") / 100000 + sysn / 10)
         .alias("sig_b_score"),
        (F.lit(10.0) * F.col("l_discount")).alias("sig_c_score"),
    )


SIGNALS = ["sig_a_score", "sig_b_score", "sig_c_score"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn paired with the assistant turn that follows it."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = conv.filter(F.col("role") == "user").alias("u")
    a = conv.filter(F.col("role") == "assistant").alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id"))
                  & (F.col("a.turn") == F.col("u.turn") + 1)).select(
        F.concat_ws("-", F.col("u.conv_id"), F.col("u.turn")).alias("row_id"),
        F.col("u.conv_id").alias("doc_id"),
        F.col("u.text").alias("src_text"),
        F.col("a.text").alias("tgt_text"),
    )


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").withColumn(
        "score", F.col("quality").cast("double") * F.lit(100.0))


def user_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "props")
    return ev.groupBy("user_id", "event_type").agg(
        F.avg("value").alias("score"),
        F.avg(F.get_json_object("props", "$.k").cast("double")).alias("sig_k_score"),
    ).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("tgt_system"),
             "score", "sig_k_score")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def decimal_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment table whose gold has two decimals; a quarter of the suppliers
    are one large source each, the other rows are grouped by order."""
    li = table(spark, sf_dir, "lineitem")
    own = F.col("l_suppkey") % 4 == 0
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"),
        F.when(own, F.col("l_suppkey")).otherwise(F.lit(1_000_000) + F.col("l_orderkey")).alias("doc_id"),
        (F.floor(F.col("l_extendedprice") / 10).cast("double") / 100).alias("score"),
        (F.col("l_quantity") / 50 + F.lit(4.0) * F.col("l_tax")).alias("sig_a_score"),
    )


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error span per lineitem (severity, confidence) keyed by order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", "l_tax")
    other = F.col("l_tax") == F.lit(OTHER_SEVERITY_TAX)
    sev = F.create_map(*[x for kv in SEVERITY_CODES.items() for x in map(F.lit, kv)])
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(other, F.lit("other")).otherwise(sev[F.col("l_returnflag")]).alias("severity"),
        F.when(other, F.lit(None).cast("double")).otherwise(F.lit(1.0) - F.col("l_discount"))
         .alias("confidence"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, spans array<struct<severity, confidence>>``; orders without
    lines get the empty list."""
    per_doc = span_rows(spark, sf_dir).groupBy("doc_id").agg(
        F.collect_list(F.struct("severity", "confidence")).alias("spans"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    empty = F.array().cast("array<struct<severity:string,confidence:double>>")
    return orders.join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("spans", empty).alias("spans"))


SAMPLE_RATE = 16000
CHARS_PER_SEC = 15


def audio_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    return seg.select(
        "row_id", "doc_id", "src_text", "tgt_text",
        F.expr(f"CAST({SAMPLE_RATE} * char_length(src_text) DIV {CHARS_PER_SEC} AS BIGINT)")
         .alias("frames"),
        F.lit(SAMPLE_RATE).alias("sample_rate"),
    )


def segments_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the following assistant turn if any (the target
    text is null where the conversation has none)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = conv.filter(F.col("role") == "user").alias("u")
    a = conv.filter(F.col("role") == "assistant").alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id"))
                  & (F.col("a.turn") == F.col("u.turn") + 1), "left").select(
        F.concat_ws("-", F.col("u.conv_id"), F.col("u.turn")).alias("row_id"),
        F.col("u.conv_id").alias("doc_id"),
        F.col("u.text").alias("src_text"),
        F.col("a.text").alias("tgt_text"),
    )


def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as the human-scored training split (0-100 scores)."""
    return ratings(spark, sf_dir).withColumn("split", F.lit("train"))


def synthetic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a synthetic split on a 0-1 scale: one row per
    document, English source, the document language as target."""
    dq = doc_quality(spark, sf_dir).filter(F.col("quality").isNotNull())
    return dq.select(F.concat(F.lit("syn-"), F.col("doc_id").cast("string")).alias("row_id"),
                     "doc_id", F.lit("en").alias("src_lang"), F.col("lang").alias("tgt_lang"),
                     F.col("quality").cast("double").alias("score"),
                     F.lit("train_synthetic").alias("split"))
