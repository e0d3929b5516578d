"""Bloom filters of bounded size as DataFrames: bitmaps of filter cells.

A filter is a table (page, bitmap) of 32,768 cells a page.  It has at most
``2 ** MAX_BITS`` cells (32 MB) at any input size, so it may be broadcast; past
that size it only lets more rows through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_ROW = 16              # filter cells for each row, while below the bound
MAX_BITS = 28                   # at most 2^28 cells: bitmaps of 32 MB together
PAGE_CELLS = 32_768             # cells in one bitmap


def filter_bits(n_rows: int) -> int:
    return min(MAX_BITS, max(18, math.ceil(math.log2(max(1, n_rows) * CELLS_PER_ROW))))


def cells(value: Column, bits: int) -> list[Column]:
    """The two cells of a value."""
    return [F.shiftrightunsigned(F.xxhash64(value, F.lit(seed)), 64 - bits) for seed in (1, 2)]


def cell_rows(df: DataFrame, value: Column, bits: int) -> DataFrame:
    """One row (cell) for each different cell of each row."""
    return df.select(F.explode(F.array_distinct(F.array(*cells(value, bits)))).alias("cell"))


def pages(cell_table: DataFrame) -> DataFrame:
    """(page, bitmap) of the cells of a table."""
    return (cell_table.groupBy((F.col("cell") / PAGE_CELLS).cast("long").alias("page"))
            .agg(F.bitmap_construct_agg(F.col("cell") % PAGE_CELLS).alias("bitmap")))


def _bit(bitmap: Column, cell: Column) -> Column:
    at = (cell % PAGE_CELLS).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def with_hit(rows: DataFrame, value: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``rows`` plus boolean ``hit``: false only where no cell row of the filter
    came from the value.  ``rows`` must not have columns page0/1, bitmap0/1."""
    hit = F.lit(True)
    names = rows.columns
    for i, cell in enumerate(cells(F.col(value), bits)):
        side = F.broadcast(bitmaps.select(F.col("page").alias(f"page{i}"), F.col("bitmap").alias(f"bitmap{i}")))
        rows = rows.join(side, (cell / PAGE_CELLS).cast("long") == F.col(f"page{i}"), "left")
        hit = hit & _bit(F.col(f"bitmap{i}"), cell)
    return rows.select(*names, hit.alias("hit"))


def without(df: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose id is in ``dropped`` (a staged table of one
    column ``id``): only rows that the filter lets through shuffle."""
    bits = filter_bits(dropped.count())
    bitmaps = pages(cell_rows(dropped, F.col("id"), bits))
    rows = with_hit(df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id")), "id", bitmaps, bits)
    stay = rows.where("hit").join(dropped, "id", "left_anti")
    return rows.where(~F.col("hit")).select("row.*").unionByName(stay.select("row.*"))
