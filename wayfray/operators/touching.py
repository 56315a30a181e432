"""Which polygons of two layers touch, and which edge of a network a point lies nearest to: both by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """The grid cells that a box meets."""
    side = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return F.explode(F.flatten(F.transform(side(x0, x1), lambda i: F.transform(side(y0, y1), lambda j: F.struct(i.alias("gx"), j.alias("gy"))))))


def touching(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """left_id, right_id of the polygons of left (left_id, geometry) and right (right_id, geometry) that have a point in common.

    Boxes meet in grid cells; a pair counts in the first cell that both boxes share, so that it is tested once.
    Geometries meet only in pairs whose boxes do."""
    def boxed(df: DataFrame, p: str) -> DataFrame:
        b = df.select(f"{p}_id", F.col("geometry").alias(f"{p}_g"), G.bounds(F.col("geometry")).alias(f"{p}_b"))
        return b.where(f"{p}_b.x0 is not null").withColumn("c", _cells(*(F.col(f"{p}_b.{k}") for k in ("x0", "y0", "x1", "y1")), cell))

    a, b = boxed(left, "left"), boxed(right, "right")
    pairs = a.join(b, "c").where((F.col("left_b.x0") <= F.col("right_b.x1")) & (F.col("left_b.x1") >= F.col("right_b.x0")) & (F.col("left_b.y0") <= F.col("right_b.y1")) & (F.col("left_b.y1") >= F.col("right_b.y0")))
    once = (F.col("c.gx") == F.floor(F.greatest("left_b.x0", "right_b.x0") / cell)) & (F.col("c.gy") == F.floor(F.greatest("left_b.y0", "right_b.y0") / cell))
    return pairs.where(once & G.rings_touch(F.col("left_g"), F.col("right_g"))).select("left_id", "right_id")


def zones_of_counties(polygons: DataFrame, boundaries: DataFrame, gid: str, cell: float) -> DataFrame:
    """The zones (gid, geometry, ...) that touch each county (fips, geometry), with fips: a zone on a border stands in every county it touches."""
    met = touching(polygons.select(F.col(gid).alias("left_id"), "geometry"), boundaries.select(F.col("fips").alias("right_id"), "geometry"), cell).distinct()
    return polygons.drop("fips").join(met.select(F.col("left_id").alias(gid), F.col("right_id").alias("fips")), gid).dropDuplicates(["fips", gid])


def to_segment(x: Column, y: Column) -> Column:
    """The distance of a point to the straight edge from (x0, y0) to (x1, y1)."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / long))).otherwise(F.lit(0.0))
    return F.hypot(x - F.col("x0") - t * dx, y - F.col("y0") - t * dy)


def conflate(points: DataFrame, net: DataFrame, within: float, cell: float | None = None, digits: int = 6) -> DataFrame:
    """fips, id, edge_id, gap: the edge nearest to each point (fips, id, x, y) of those at most ``within`` away, the least of equals.

    Each edge stands in the cells of its box, widened by ``within``; a point is in one cell."""
    cell = 4 * within if cell is None else cell
    low, high = lambda c: F.least(f"{c}0", f"{c}1") - within, lambda c: F.greatest(f"{c}0", f"{c}1") + within
    edges = net.select("fips", "edge_id", "x0", "y0", "x1", "y1").withColumn("c", _cells(low("x"), low("y"), high("x"), high("y"), cell))
    own = points.select("fips", "id", F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn("c", F.struct(F.floor(F.col("_x") / cell).alias("gx"), F.floor(F.col("_y") / cell).alias("gy")))
    near = own.join(edges, ["fips", "c"]).withColumn("gap", F.round(to_segment(F.col("_x"), F.col("_y")), digits)).where(F.col("gap") <= within)
    return near.groupBy("fips", "id").agg(F.min(F.struct("gap", "edge_id")).alias("m")).select("fips", "id", "m.edge_id", "m.gap")


def measured_fitness(net: DataFrame, ratings: DataFrame, within: float) -> DataFrame:
    """net with ``fitness``, the mean rating (0 to 1) of the rated points (fips, id, x, y, rating) on each edge; null where there is none, so that its class counts."""
    met = conflate(ratings, net, within).join(ratings.select("fips", "id", "rating"), ["fips", "id"])
    mean = met.groupBy("fips", "edge_id").agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rating")))).alias("fitness"))
    return net.drop("fitness").join(mean, ["fips", "edge_id"], "left")
