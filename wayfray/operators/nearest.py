"""The nearest target of each point, for any number of either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import frozen


def nearest_join(points: DataFrame, targets: DataFrame, cell: float, by: list[str] | None = None, digits: int = 6, widest: int = 40) -> DataFrame:
    """by..., id, target, gap: of the targets (by..., target, x, y) the nearest to each point (by..., id, x, y), the least of equals.

    Points meet the targets of their cell and its eight neighbours; a target no farther than a cell's side
    is the nearest of all. Points without one go on with cells four times as wide. Distances are compared
    to ``digits`` decimals. Points without any target have no row."""
    by = by or []
    left = frozen(points.select(*by, "id", F.col("x").alias("_px"), F.col("y").alias("_py")).where("_px is not null and _py is not null"))
    targets = frozen(targets.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.min("target").alias("target")))  # of those in one place the least is met
    some = targets.select(*by).distinct() if by else None
    left = frozen(left.join(some, by, "left_semi")) if by else left if not targets.isEmpty() else left.where("false")
    out = None
    for _ in range(widest):
        if left.isEmpty():
            break
        around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / cell) + i).alias("cx"), (F.floor(F.col("y") / cell) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        near = targets.select(*by, "target", "x", "y", around.alias("c")).select(*by, "target", "x", "y", "c.cx", "c.cy")
        own = left.withColumns({"cx": F.floor(F.col("_px") / cell), "cy": F.floor(F.col("_py") / cell)})
        gap = F.round(F.hypot(F.col("_px") - F.col("x"), F.col("_py") - F.col("y")), digits)
        met = own.join(near, [*by, "cx", "cy"]).groupBy(*by, "id").agg(F.min(F.struct(gap.alias("gap"), "target")).alias("m"))
        sure = frozen(met.where(F.col("m.gap") <= cell).select(*by, "id", "m.target", "m.gap"))
        out = sure if out is None else out.unionByName(sure)
        left = frozen(left.join(sure, [*by, "id"], "left_anti"))
        cell *= 4
    else:
        raise RuntimeError("some points are too far from every target for the first cell's side")
    return left.select(*by, "id", F.lit(None).cast(dict(targets.dtypes)["target"]).alias("target"), F.lit(0.0).alias("gap")).where("false") if out is None else out
