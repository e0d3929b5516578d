"""Corpus pipeline: raw documents to a mixed, encoded training set.

``STAGES`` in order: documents that the toxicity models reject go, of equal
texts one stays, of near-duplicates one stays, sources are mixed to their
target weights (a row comes as often as the mix takes it), and every text is
encoded and decoded.  Each stage is a function (spark, docs, sf_dir) and works
on all rows it is given; all but the last return the columns they are given.

The library's tokeniser and the language models have no SQL twin
(``ORACLE_SQL`` is None); the stages are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.llm import bloom, exact_dedup, jaccard_join, mixing, pieces, toxicity
from vetta.llm.common import free_name, staged, table, word_count
from vetta.llm.entries import TOXIC_SCORE, piece_digests, piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the toxicity threshold (a null text scores as an
    empty one)."""
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1]) < TOXIC_SCORE).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z, the row with the largest id."""
    key = free_name(docs, "text_sha256")
    return exact_dedup.deduplicated(exact_dedup.with_hash(docs, hash_col=key), hash_col=key).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by near-duplicate links one row, of the smallest
    id (a null id only where no row has one); texts without words stay."""
    groups = staged(jaccard_join.near_duplicates(docs).where("node is not null"), "near-groups")
    first = F.struct(F.col("id").isNull().alias("gap"), "id", "row_key")
    kept = groups.groupBy("component").agg(F.min(first).alias("kept"), F.count("*").alias("n")).where("n > 1")
    marked = groups.join(kept, "component").groupBy("row_key").agg(F.max(F.col("row_key") == F.col("kept.row_key")).alias("stays"))
    marked = staged(marked.select(F.col("row_key").alias("id"), "stays"), "near-copies")
    bits = bloom.filter_bits(marked.count())
    bitmaps = bloom.pages(bloom.cell_rows(marked, F.col("id"), bits))
    rows = docs.select(F.struct(*docs.columns).alias("row"), jaccard_join.row_key("doc_id", "text").alias("id"))
    rows = bloom.with_hit(rows, "id", bitmaps, bits)
    judged = rows.where("hit").join(marked, "id", "left")
    once = judged.where("stays").dropDuplicates(["id"])         # equal rows
    return (rows.where(~F.col("hit")).select("row.*").unionByName(judged.where("stays is null").select("row.*"))
            .unionByName(once.select("row.*")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    size = free_name(docs, "words")
    mixed = mixing.mix(docs.withColumn(size, word_count(F.col("text"))), size)
    times = mixed.columns[-1]
    return mixed.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every row, and digest of their decoding."""
    return piece_digests(pieces.encode_decode(docs.select("doc_id", "text"), piece_model()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
