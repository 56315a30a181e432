"""Road networks: filters, noding, node coordinates, summaries, the giant component.

A raw edge layer has edge_id and a line (``geometry``), and may have ROADFLG, MTFCC,
TNIDF/TNIDT, LINEARID/FULLNAME and fips. A network is a DataFrame of edges (fips, edge_id,
src, dst, length_m, mtfcc, road_key, x0, y0, x1, y1, mid_x, mid_y); parallel edges stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import ROAD_SETS, UNNAMED
from .components import components, contracted_components, frozen


def road_filter(edges: DataFrame, roads: str = "drive") -> DataFrame:
    """Edges flagged as roads, of a set of classes. A test whose column is absent is skipped."""
    if roads not in ROAD_SETS:
        raise ValueError(f"unknown road set {roads!r}; one of {sorted(ROAD_SETS)}")
    if "ROADFLG" in edges.columns:
        edges = edges.where(F.upper(F.col("ROADFLG").cast("string")) == "Y")
    if ROAD_SETS[roads] is not None and "MTFCC" in edges.columns:
        edges = edges.where(F.col("MTFCC").isin(*ROAD_SETS[roads]))
    return edges


def id_nodes(edges: DataFrame) -> DataFrame:
    """src and dst from the layer's own node ids; edges with an id that is no number go."""
    return edges.withColumns({"src": F.expr("try_cast(TNIDF as bigint)"), "dst": F.expr("try_cast(TNIDT as bigint)")}).na.drop(subset=["src", "dst"])


def grid_nodes(edges: DataFrame, tol: float = 1.0) -> DataFrame:
    """src and dst from end points snapped to a grid of ``tol``; joins crossings at different heights."""
    def cell(p):  # both cells in one number, in the order (x, y)
        return F.shiftleft(F.rint(p.x / tol).cast("bigint"), 32) + F.rint(p.y / tol).cast("bigint") + F.lit(2**31)

    return edges.withColumns({"src": cell(F.element_at("geometry", 1)), "dst": cell(F.element_at("geometry", -1))})


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def measured(edges: DataFrame) -> DataFrame:
    """The network's columns from noded edges."""
    has = edges.columns
    line = F.col("geometry")
    first, last, mid = F.element_at(line, 1), F.element_at(line, -1), G.halfway(line)
    road = "LINEARID" if "LINEARID" in has else "FULLNAME" if "FULLNAME" in has else None
    return edges.select(
        (F.col("fips") if "fips" in has else F.lit("")).alias("fips"), "edge_id", "src", "dst", G.line_length(line).alias("length_m"),
        (F.col("MTFCC") if "MTFCC" in has else F.lit(None).cast("string")).alias("mtfcc"),
        (F.coalesce(F.col(road), F.lit(UNNAMED)) if road else F.lit(None).cast("string")).alias("road_key"),
        first.x.alias("x0"), first.y.alias("y0"), last.x.alias("x1"), last.y.alias("y1"), mid.x.alias("mid_x"), mid.y.alias("mid_y"),
    )


def build_network(raw: DataFrame, roads: str = "drive", project: bool = False, tol: float = 1.0, giant_only: bool = True, self_loops: bool = False, check_empty: bool = True) -> DataFrame:
    """Filter, project, node, measure, and keep the giant component of each county."""
    kept = road_filter(raw, roads)
    if check_empty and kept.isEmpty():
        raise ValueError(f"no edge is left by the road set {roads!r}")
    if project:
        kept = kept.withColumn("geometry", G.project_line(F.col("geometry")))
    noded = id_nodes(kept) if {"TNIDF", "TNIDT"} <= set(kept.columns) else grid_nodes(kept, tol)
    net = measured(noded if self_loops else drop_self_loops(noded))
    return giant_component(net) if giant_only else net


def ends(net: DataFrame) -> DataFrame:
    """A row per edge end: fips, edge_id, node, x, y."""
    side = lambda n, x, y: F.struct(F.col(n).alias("node"), F.col(x).alias("x"), F.col(y).alias("y"))
    return net.select("fips", "edge_id", F.explode(F.array(side("src", "x0", "y0"), side("dst", "x1", "y1"))).alias("e")).select("fips", "edge_id", "e.*")


def nodes(net: DataFrame) -> DataFrame:
    """fips, node, x, y: the mean of the ends that meet there."""
    return ends(net).groupBy("fips", "node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def degree(net: DataFrame) -> DataFrame:
    return net.select("fips", F.explode(F.array("src", "dst")).alias("node")).groupBy("fips", "node").agg(F.count("*").alias("degree"))


def summary(net: DataFrame) -> DataFrame:
    """fips, n_nodes, n_edges, mean_degree, total_km, deg_1_frac .. deg_5_frac."""
    shares = [F.avg((F.col("degree") == k).cast("double")).alias(f"deg_{k}_frac") for k in range(1, 6)]
    by_node = degree(net).groupBy("fips").agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), *shares)
    by_edge = net.groupBy("fips").agg(F.count("*").alias("n_edges"), (F.sum("length_m") / 1000).alias("total_km"))
    return by_node.join(by_edge, "fips").select("fips", "n_nodes", "n_edges", "mean_degree", "total_km", *(f"deg_{k}_frac" for k in range(1, 6)))


def giant_labels(labels: DataFrame, by: list[str]) -> DataFrame:
    """by..., label, size of the component with most nodes; of equals the one of the least node."""
    sizes = labels.groupBy(*by, "label").agg(F.count("*").alias("size"))
    return sizes.groupBy(*by).agg(F.min(F.struct((-F.col("size")).alias("s"), "label")).alias("b")).select(*by, "b.label", (-F.col("b.s")).alias("size"))


def giant_component(net: DataFrame, one_graph: bool = False) -> DataFrame:
    """The edges of each county's giant component. Counties of more edges than a task may label,
    or with ``one_graph`` all, are labelled in distributed rounds."""
    net = frozen(net)  # met three times
    labels = frozen(contracted_components(net, ["fips"]) if one_graph else components(net, ["fips"]))  # met twice
    best = giant_labels(labels, ["fips"])
    inside = labels.join(best.select("fips", "label"), ["fips", "label"], "left_semi").select("fips", F.col("node").alias("src"))
    return net.join(inside, ["fips", "src"], "left_semi").select(*net.columns)
