"""Layers landed as Parquet in an order that keeps neighbours together, so that a box reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16


def _spread(v: Column) -> Column:
    """The bits of a whole number under 2 ** 16, every other place free."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def curve_place(x: Column, y: Column) -> Column:
    """Where a cell (each side a whole number under 2 ** 16) stands on a curve through all cells that stays near itself (Z-order)."""
    return _spread(x.cast("bigint")).bitwiseOR(F.shiftleft(_spread(y.cast("bigint")), 1))


def land(df: DataFrame, folder: str, box: Column, row_group_mb: float = 32.0, files: int | None = None) -> None:
    """Writes a layer with columns box_x0, box_y0, box_x1, box_y1 (of ``box``, a struct), range-partitioned and sorted along the curve of the boxes' middles.

    Row groups then hold neighbours, and their statistics of the box columns let a reader skip those outside a box."""
    b = df.withColumn("_b", box)
    b = b.select(*df.columns, *(F.col(f"_b.{k}").alias(f"box_{k}") for k in ("x0", "y0", "x1", "y1")))
    lo_x, hi_x, lo_y, hi_y = b.agg(F.min("box_x0"), F.max("box_x1"), F.min("box_y0"), F.max("box_y1")).first()
    cell = lambda c, lo, hi: F.floor((F.col(f"box_{c}0") + F.col(f"box_{c}1") - 2 * (lo or 0.0)) / 2 / max((hi or 0.0) - (lo or 0.0), 1e-9) * (2**BITS - 1))
    placed = b.withColumn("_z", curve_place(cell("x", lo_x, hi_x), cell("y", lo_y, hi_y)))
    dealt = placed.repartitionByRange("_z") if files is None else placed.repartitionByRange(files, "_z")
    dealt.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.size", int(row_group_mb * 2**20)).parquet(folder)


def read_box(spark: SparkSession, folder: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A landed layer's rows whose boxes meet ``box`` (x0, y0, x1, y1); the condition goes down to the scan."""
    df = spark.read.parquet(folder)
    if box is None:
        return df
    x0, y0, x1, y1 = map(F.lit, box)
    return df.where((F.col("box_x0") <= x1) & (F.col("box_x1") >= x0) & (F.col("box_y0") <= y1) & (F.col("box_y1") >= y0))
