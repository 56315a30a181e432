"""Zones: which zone an edge's midpoint lies in, small zones, anchors, p-median areas.

zones: fips, level, zone_idx, zone_id, geometry, cx, cy, anchor_node.
edge_zone: fips, level, edge_id, zone_idx (null: in no zone), and share where an edge counts by parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import GEOID_COLUMNS
from .components import frozen
from .nearest import nearest_join
from .network import ends, nodes


def geoid_column(df: DataFrame) -> str:
    for c in GEOID_COLUMNS:
        if c in df.columns:
            return c
    raise KeyError(f"none of {GEOID_COLUMNS} among {df.columns}")


def number_zones(polygons: DataFrame, level: str, fips: str = "", order: str | None = None) -> DataFrame:
    """zones of a polygon layer, numbered in the order of ``order`` (the id by default)."""
    gid = geoid_column(polygons)
    place = F.row_number().over(W.partitionBy("fips", "level").orderBy(order or gid)) - 1
    base = polygons.withColumns({"fips": F.col("fips") if "fips" in polygons.columns else F.lit(fips), "level": F.lit(level)})
    c = G.centroid(F.col("geometry"))
    return base.select("fips", "level", place.cast("int").alias("zone_idx"), F.col(gid).cast("string").alias("zone_id"), "geometry", c.x.alias("cx"), c.y.alias("cy"))


def point_in_zone(net: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """edge_zone by midpoints: points meet polygons in the grid cells of the polygons' boxes; of several zones the first counts."""
    b = G.bounds(F.col("geometry"))
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    boxed = (
        zones.select("fips", "level", "zone_idx", "geometry", b.alias("b"))
        .withColumn("gx", F.explode(cells(F.col("b.x0"), F.col("b.x1"))))
        .withColumn("gy", F.explode(cells(F.col("b.y0"), F.col("b.y1"))))
    )
    mids = net.select("fips", "edge_id", "mid_x", "mid_y", F.floor(F.col("mid_x") / cell).alias("gx"), F.floor(F.col("mid_y") / cell).alias("gy"))
    hit = mids.join(boxed, ["fips", "gx", "gy"]).where(F.col("mid_x").between(F.col("b.x0"), F.col("b.x1")) & F.col("mid_y").between(F.col("b.y0"), F.col("b.y1")))
    inside = hit.where(G.contains(F.col("geometry"), F.col("mid_x"), F.col("mid_y"))).groupBy("fips", "level", "edge_id").agg(F.min("zone_idx").alias("zone_idx"))
    every = net.select("fips", "edge_id").join(zones.select("fips", "level").distinct(), "fips")
    return every.join(inside, ["fips", "level", "edge_id"], "left").select("fips", "level", "edge_id", "zone_idx")


def edges_per_zone(edge_zone: DataFrame) -> DataFrame:
    return edge_zone.where("zone_idx is not null").groupBy("fips", "level", "zone_idx").agg(F.count("*").alias("n_edges"))


def anchors(net: DataFrame, edge_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """fips, level, zone_idx, anchor_node: of the nodes of a zone's edges the nearest to its centroid (the least node of equals)."""
    near = ends(net).select("fips", "edge_id", "node").join(edge_zone.where("zone_idx is not null"), ["fips", "edge_id"]).select("fips", "level", "zone_idx", "node").distinct()
    far = near.join(nodes(net), ["fips", "node"]).join(zones.select("fips", "level", "zone_idx", "cx", "cy"), ["fips", "level", "zone_idx"])
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return far.groupBy("fips", "level", "zone_idx").agg(F.min(F.struct(F.round(d, 6).alias("d"), "node")).alias("m")).select("fips", "level", "zone_idx", F.col("m.node").alias("anchor_node"))


def drop_small_zones(edge_zone: DataFrame, zones: DataFrame, min_edges: int = 5) -> tuple[DataFrame, DataFrame]:
    """Zones of fewer edges, or with no anchor, go; the rest are numbered anew; the edges of those that went stay, in no zone."""
    n = edges_per_zone(edge_zone).where(F.col("n_edges") >= min_edges)
    kept = zones.where("anchor_node is not null").join(n.select("fips", "level", "zone_idx"), ["fips", "level", "zone_idx"], "left_semi")
    new = kept.withColumn("_new", (F.row_number().over(W.partitionBy("fips", "level").orderBy("zone_idx")) - 1).cast("int"))
    ez = edge_zone.join(new.select("fips", "level", "zone_idx", "_new"), ["fips", "level", "zone_idx"], "left").select("fips", "level", "edge_id", F.col("_new").alias("zone_idx"))
    return ez, new.drop("zone_idx").withColumnRenamed("_new", "zone_idx")


def assign_by_polygons(net: DataFrame, zones: DataFrame, cell: float, drop_empty: bool = True, min_edges: int = 5) -> tuple[DataFrame, DataFrame]:
    """edge_zone and zones with anchors."""
    ez = frozen(point_in_zone(net, zones, cell))  # met again by counts and anchors
    full = zones.drop("geometry").join(anchors(net, ez, zones), ["fips", "level", "zone_idx"], "left")
    return drop_small_zones(ez, full, min_edges) if drop_empty else (ez, full)


#: Centres of a county that stand packed beside each point; more are met by cells.
PACKED = 64


def nearest_centre(points: DataFrame, centres: DataFrame, cell: float | None = None) -> DataFrame:
    """points (fips, edge_id, mid_x, mid_y) with zone_idx, the nearest of their county's centres (fips, zone_idx, x, y); the least of equals.

    Without ``cell`` a county's centres go along packed, for a handful; with it points meet centres by grid cells."""
    if cell is not None:
        own = points.select("fips", F.col("edge_id").alias("id"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y"))
        near = nearest_join(own, centres.withColumnRenamed("zone_idx", "target"), cell, ["fips"], digits=9)
        return points.join(near.select("fips", F.col("id").alias("edge_id"), F.col("target").alias("zone_idx")), ["fips", "edge_id"])
    packed = centres.groupBy("fips").agg(F.collect_list(F.struct("zone_idx", "x", "y")).alias("_c"))
    far = F.transform("_c", lambda c: F.struct(F.hypot(F.col("mid_x") - c.x, F.col("mid_y") - c.y).alias("d"), c.zone_idx.alias("i")))
    return points.join(F.broadcast(packed), "fips").withColumn("zone_idx", F.array_min(far).getField("i")).drop("_c")


def moved_centres(labelled: DataFrame, centres: DataFrame) -> DataFrame:
    """centres at the mean of their points, with ``moved``; a centre without points stays."""
    means = labelled.groupBy("fips", "zone_idx").agg(F.avg("mid_x").alias("_x"), F.avg("mid_y").alias("_y"))
    both = centres.select("fips", "zone_idx", "x", "y").join(means, ["fips", "zone_idx"], "left")
    x, y = F.coalesce("_x", "x"), F.coalesce("_y", "y")
    still = (F.abs(x - F.col("x")) <= 1e-8 + 1e-5 * F.abs("x")) & (F.abs(y - F.col("y")) <= 1e-8 + 1e-5 * F.abs("y"))
    return both.select("fips", "zone_idx", x.alias("x"), y.alias("y"), (~still).alias("moved"))


def assign_by_pmedian(net: DataFrame, k: int = 5, seed: int = 0, rounds: int = 60, cell: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """k Euclidean service areas of each county by Lloyd's rounds over edge midpoints, all counties at once, from the k midpoints of least hash.

    The rounds end when no centre of any county moves."""
    level = f"pmedian{k}"
    mids = frozen(net.select("fips", "edge_id", "mid_x", "mid_y"))
    key = G.md5_bits(F.concat_ws("|", F.lit("pmedian"), F.lit(seed), "edge_id"))
    place = F.row_number().over(W.partitionBy("fips").orderBy(key, "edge_id"))
    centres = frozen(mids.withColumn("_i", place).where(F.col("_i") <= k).select("fips", (F.col("_i") - 1).cast("int").alias("zone_idx"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y")))
    by_cell = cell if k > PACKED else None
    for _ in range(rounds):
        new = frozen(moved_centres(nearest_centre(mids, centres, by_cell), centres))
        if new.where("moved").isEmpty():
            break
        centres = new.drop("moved")
    ez = nearest_centre(mids, centres, by_cell).select("fips", F.lit(level).alias("level"), "edge_id", "zone_idx")
    zones = centres.select("fips", F.lit(level).alias("level"), "zone_idx", F.col("zone_idx").cast("string").alias("zone_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return ez, zones.join(anchors(net, ez, zones), ["fips", "level", "zone_idx"], "left")


def assign_by_sides(net: DataFrame, sides: DataFrame, level: str = "sides", min_edges: float = 0) -> tuple[DataFrame, DataFrame]:
    """edge_zone with ``share``, and zones with anchors, from the zones on the two sides of each edge: sides (fips, edge_id, left, right).

    An edge between two zones counts by halves to both, one inside a zone or at the rim of the map whole to its zone, one
    without any to none. Zones are numbered in the order of their ids; a zone's centre is the mean of its midpoints by share."""
    named = net.select("fips", "edge_id", "mid_x", "mid_y").join(sides.select("fips", "edge_id", "left", "right"), ["fips", "edge_id"], "left")
    both = F.array_compact(F.array_distinct(F.array(F.col("left").cast("string"), F.col("right").cast("string"))))
    parts = named.withColumn("_z", both).select("fips", "edge_id", "mid_x", "mid_y", F.explode_outer("_z").alias("zone_id"), (1 / F.greatest(F.size("_z"), F.lit(1))).alias("share"))
    parts = frozen(parts)
    s = F.col("share")
    zones = parts.where("zone_id is not null").groupBy("fips", "zone_id").agg((F.sum(F.col("mid_x") * s) / F.sum(s)).alias("cx"), (F.sum(F.col("mid_y") * s) / F.sum(s)).alias("cy"), F.sum(s).alias("_n")).where(F.col("_n") >= min_edges).drop("_n")
    place = (F.row_number().over(W.partitionBy("fips").orderBy("zone_id")) - 1).cast("int")
    zones = frozen(zones.withColumns({"zone_idx": place, "level": F.lit(level)}).select("fips", "level", "zone_idx", "zone_id", "cx", "cy"))
    ez = parts.join(zones.select("fips", "zone_id", "zone_idx"), ["fips", "zone_id"], "left").select("fips", F.lit(level).alias("level"), "edge_id", "zone_idx", "share")
    return ez, zones.join(anchors(net, ez, zones), ["fips", "level", "zone_idx"], "left")


def all_levels(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The union of several assignments."""
    ez, zs = parts[0]
    for e, z in parts[1:]:
        ez, zs = ez.unionByName(e), zs.unionByName(z)
    return ez, zs


def select_zone_polygons(polygons: DataFrame, level: str, fips: str, boundary: DataFrame | None = None) -> DataFrame:
    """A zone layer cut to a county: by its codes, or for layers across counties by touching the boundary."""
    fips = str(fips).zfill(5)
    if level == "zcta":
        gid = geoid_column(polygons)
        edge = boundary.select(F.col("geometry").alias("_g"), G.bounds(F.col("geometry")).alias("_b"))
        own = G.bounds(F.col("geometry"))
        box = (own.x0 <= F.col("_b.x1")) & (own.x1 >= F.col("_b.x0")) & (own.y0 <= F.col("_b.y1")) & (own.y1 >= F.col("_b.y0"))
        return polygons.join(F.broadcast(edge.limit(1)), box & G.rings_touch(F.col("geometry"), F.col("_g")), "left_semi").dropDuplicates([gid])  # the boundary is one row
    if level not in ("block", "bg", "tract"):
        raise ValueError(f"unknown level {level!r}")
    for s, c in (("STATEFP", "COUNTYFP"), ("STATEFP20", "COUNTYFP20")):
        if s in polygons.columns and c in polygons.columns:
            return polygons.where((F.col(s) == fips[:2]) & (F.col(c) == fips[2:]))
    raise KeyError("the layer has no state and county codes")
