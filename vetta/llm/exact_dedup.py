"""Exact deduplication: two-pass Bloom filtering, DataFrame functions only.

Pass one drops every row's text hash into the cells of a Bloom filter and
keeps the cells hit at least twice, as bitmaps of 32,768 cells.  Pass two looks
each row up in those bitmaps (broadcast; their size is bounded by
``bloom.MAX_BITS`` at any input size): a row with a cell hit once has a unique text and passes
straight through; only the others shuffle, where equality of the SHA-256 of
the normalised text decides.  False hits of the filter cost a shuffle of that
row, never a wrong answer.

Defined cases: a null text counts as empty; equal (id, text) rows are the same
document and get the same answer; a null id never wins against an id; an empty
table gives an empty result; input columns stay as they are (added columns
that clash with them get underscores in front, see ``ADDED``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetta.llm import bloom
from vetta.llm.common import free_name, lower_ascii, staged

ADDED = ("keep_id", "group_size", "kept")


def text_hash(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text: A-Z lowered, null as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def with_hash(df: DataFrame, text_col: str = "text", hash_col: str = "text_sha256") -> DataFrame:
    return df.withColumn(hash_col, text_hash(F.col(text_col)))


def repeated_cells(df: DataFrame, hash_col: str, bits: int) -> DataFrame:
    """Pass one: bitmaps of the filter cells that at least two rows hit."""
    hits = bloom.cell_rows(df, F.col(hash_col), bits).groupBy("cell").agg(F.count("*").alias("hits"))
    return bloom.pages(hits.where("hits > 1"))


def _parted(df: DataFrame, id_col: str, hash_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass straight through, and judged rows with ``keep`` (the id
    that stays) and ``n`` (rows of equal text)."""
    bits = bloom.filter_bits(df.count())
    bitmaps = staged(repeated_cells(df, hash_col, bits), "bloom")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), F.col(hash_col).alias("hash"))
    rows = bloom.with_hit(rows, "hash", bitmaps, bits)
    again = rows.where("hit").drop("hit")
    groups = staged(again.groupBy("hash").agg(F.max("id").alias("keep"), F.count("*").alias("n")), "copies")
    return rows.where(~F.col("hit")).drop("hit"), again.join(groups, "hash")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", hash_col: str = "text_sha256") -> DataFrame:
    """``df`` (with a text hash column, see ``with_hash``) plus ``keep_id``,
    ``group_size`` and ``kept``: of rows with equal hashes the one with the
    largest id stays."""
    unique, judged = _parted(df, id_col, hash_col)
    keep, size, kept = (free_name(df, c) for c in ADDED)
    marked = (unique.select("row", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"))
              .unionByName(judged.select("row", "keep", "n")))
    return marked.select("row.*", F.col("keep").alias(keep), F.col("n").alias(size),
                         F.col(f"row.{id_col}").eqNullSafe(F.col("keep")).alias(kept))


def deduplicated(df: DataFrame, id_col: str = "doc_id", hash_col: str = "text_sha256") -> DataFrame:
    """The rows of ``df`` that stay, one for each text (of equal rows any)."""
    unique, judged = _parted(df, id_col, hash_col)
    kept = judged.where(F.col("id").eqNullSafe(F.col("keep"))).dropDuplicates(["hash"])
    return unique.select("row.*").unionByName(kept.select("row.*"))
