"""Registered queries of the fragmentation engine, over the customer lattice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import betweenness as B
from ..operators import curves as C
from ..operators import deletion as D
from ..operators import network as N
from ..operators import powerlaw as P
from ..operators import sweep as S
from ..operators import trial as T
from ..operators import touching as X
from ..operators import zoning as Z
from ..operators.components import contracted_components, frozen, keyed_components, shared_folder, star_components
from ..functions import geometry as G
from ..sources import landing
from . import county, sql
from . import surrogates as U

PS, REPLICATES = [0.1, 0.2, 0.3, 0.4, 0.5], 2
CENTRES, SOURCES = sql.CENTRES, sql.SOURCES


def _r(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def road_filter(spark: SparkSession, d: str) -> DataFrame:
    return N.road_filter(U.lattice(spark, d)).select("edge_id", "MTFCC")


def road_filter_main(spark, d):
    return N.road_filter(U.lattice(spark, d), "main").select("edge_id", "MTFCC")


def try_numeric_nodes(spark, d):
    return N.id_nodes(U.messy(U.lattice(spark, d))).select("edge_id", "src", "dst")


def self_loop_drop(spark, d):
    return N.drop_self_loops(N.id_nodes(U.messy(U.lattice(spark, d)))).select("edge_id", "src", "dst")


def _open(spark, d):
    return U.network(spark, d, giant_only=False)


def degree(spark, d):
    return N.degree(_open(spark, d)).select("node", "degree")


def network_summary(spark, d):
    return _r(N.summary(U.network(spark, d)), "mean_degree", "total_km", *(f"deg_{k}_frac" for k in range(1, 6)))


def node_coords(spark, d):
    return N.nodes(_open(spark, d)).select("node", "x", "y")


def geometric_noding(spark, d):
    e = N.grid_nodes(U.lattice(spark, d).drop("TNIDF", "TNIDT"), tol=150.0)
    return e.groupBy("src", "dst").agg(F.count("*").alias("n"))


def components(spark, d):
    return star_components(_open(spark, d).select("src", "dst"))


def _new_counties(spark, d):
    """The nations' edge layers, but for those that are done."""
    done = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 9500").select(U._code("s_nationkey").alias("fips"))
    return U.counties(spark, d).join(done, "fips", "left_anti")


def components_keyed(spark, d):
    """Every nation's graph, a graph to a task."""
    return keyed_components(N.build_network(_new_counties(spark, d), giant_only=False, check_empty=False), ["fips"])


def giant_of_each(spark, d):
    """The giant component of every nation's graph."""
    return N.build_network(_new_counties(spark, d), check_empty=False).select("fips", "edge_id", "src", "dst")


def components_contracted(spark, d):
    """What tasks connect by themselves is merged first, in runs of few edges here."""
    return contracted_components(_open(spark, d), [], chunk=500).select("node", "label")


def giant_component(spark, d):
    return N.giant_labels(star_components(_open(spark, d), by=["fips"]), ["fips"])


def restrict_giant(spark, d):
    return U.network(spark, d).select("edge_id", "src", "dst", "length_m")


def edge_midpoint(spark, d):
    return _open(spark, d).select("edge_id", "mid_x", "mid_y")


def point_in_zone_first_match(spark, d):
    net = U.network(spark, d)
    return Z.point_in_zone(net, U.zone_grid(spark, d, "medium"), 400.0).select("edge_id", "zone_idx")


def edges_per_zone(spark, d):
    net = U.network(spark, d)
    return Z.edges_per_zone(Z.point_in_zone(net, U.zone_grid(spark, d, "medium"), 400.0)).select("zone_idx", "n_edges")


def zone_anchor(spark, d):
    net = U.network(spark, d)
    _, zs = U.assigned(spark, d, net, ("medium",), drop_empty=False)
    return zs.select("zone_id", "cx", "cy", "anchor_node")


def drop_small_zones(spark, d):
    net = U.network(spark, d)
    ez, zs = U.assigned(spark, d, net, ("medium",))
    return Z.edges_per_zone(ez).join(zs, ["fips", "level", "zone_idx"]).select("zone_idx", "zone_id", "n_edges", "anchor_node")


def _centres(spark, d, n=None):
    """Given centres, or as many as suppliers."""
    if n is None:
        return spark.createDataFrame([(U.FIPS, i, x, y) for i, (x, y) in enumerate(CENTRES)], "fips string, zone_idx int, x double, y double")
    return U.supplier_points(spark, d).select("fips", F.col("id").cast("int").alias("zone_idx"), "x", "y")


def nearest_centre(spark, d):
    """One round: each midpoint's nearest centre, then the centres' new places."""
    mids, centres = U.network(spark, d).select("fips", "edge_id", "mid_x", "mid_y"), _centres(spark, d)
    near = Z.nearest_centre(mids, centres)
    return _r(near.groupBy("zone_idx").agg(F.count("*").alias("n"), F.avg("mid_x").alias("x"), F.avg("mid_y").alias("y")), "x", "y", digits=6)


def nearest_of_many(spark, d):
    """Each midpoint's nearest of as many centres as there are suppliers, by grid cells."""
    mids = U.network(spark, d).select("fips", "edge_id", "mid_x", "mid_y")
    return Z.nearest_centre(mids, _centres(spark, d, "many"), cell=150.0).select("edge_id", "zone_idx")


def pmedian(spark, d):
    ez, zs = Z.assign_by_pmedian(U.network(spark, d), 5)
    return Z.edges_per_zone(ez).join(zs, ["fips", "level", "zone_idx"]).select("zone_idx", "n_edges", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), "anchor_node")


def _sc(spark, ps=PS, replicates=REPLICATES, protocols=("random",), units=("edge",)):
    return D.scenarios(spark, ps, replicates, protocols, units)


def _deleted(spark, d, protocol, unit):
    gone = D.deletions(U.network(spark, d), _sc(spark, protocols=(protocol,), units=(unit,)))
    return gone.where("deleted").select("p_milli", "replicate", "edge_id")


def delete_random_edge(spark, d):
    return _deleted(spark, d, "random", "edge")


def delete_fitness_edge(spark, d):
    return _deleted(spark, d, "fitness", "edge")


def delete_random_road(spark, d):
    return _deleted(spark, d, "random", "road")


def delete_fitness_road(spark, d):
    return _deleted(spark, d, "fitness", "road")


def edge_betweenness(spark, d):
    return _r(B.edge_betweenness(U.network(spark, d), SOURCES), "betweenness", digits=6).select("edge_id", "betweenness")


def delete_betweenness_edge(spark, d):
    gone = D.deletions(U.network(spark, d), D.scenarios(spark, [0.05, 0.1, 0.2], 1, ("betweenness",)), n_sources=SOURCES)
    return gone.where("deleted").select("p_milli", "edge_id")


def trial_betweenness(spark, d):
    """The targeted attack's fragmentation by zone."""
    net = U.network(spark, d)
    ez, zs = U.assigned(spark, d, net)
    gone = frozen(D.deletions(net, D.scenarios(spark, [0.05, 0.1, 0.2], 1, ("betweenness",)), n_sources=SOURCES))
    return T.per_zone(gone, ez, zs).select("p_milli", "level", "zone_idx", "n_total", "n_deleted", "n_marooned")


def sample_by_thresholds(spark, d):
    """Random deletion without a sort of the county: the k-th key by counts of key prefixes."""
    gone = D.delete_edges(U.network(spark, d), _sc(spark), most=50)
    return gone.where("deleted").select("p_milli", "replicate", "edge_id")


def sample_by_thresholds_fitness(spark, d):
    gone = D.delete_edges(U.network(spark, d), _sc(spark, protocols=("fitness",)), most=50)
    return gone.where("deleted").select("p_milli", "replicate", "edge_id")


def snap_facilities(spark, d):
    """Each facility's nearest node of the network."""
    return A.snap(U.facilities(spark, d), U.network(spark, d), 150.0).select("id", "node", "gap")


def accessibility(spark, d):
    """Distance to the nearest facility along what survives."""
    net = U.network(spark, d)
    places = frozen(A.snap(U.facilities(spark, d), net, 150.0))
    a = A.accessibility(frozen(D.deletions(net, _sc(spark))), places)
    return _r(a, "unreachable_frac", "mean_m", "max_m", digits=6).select("p_milli", "replicate", "n_nodes", "n_unreachable", "unreachable_frac", "mean_m", "max_m")


def trial_contracted(spark, d):
    """A trial whose graphs are larger than a task may label."""
    net = U.network(spark, d)
    ez, zs = U.assigned(spark, d, net)
    gone = frozen(D.deletions(net, _sc(spark)))
    return T.per_zone(gone, ez, zs, labels=frozen(T.surviving_labels(gone, per_task=100))).select("p_milli", "replicate", "level", "zone_idx", "n_total", "n_deleted", "n_marooned")


def _trial(spark, d, scope, strict=False):
    net = U.network(spark, d)
    ez, zs = U.assigned(spark, d, net)
    return S.trials(net, ez, zs, _sc(spark), (scope,), strict)[0]


def trial_county(spark, d):
    return _trial(spark, d, "county").select("p_milli", "replicate", "level", "zone_idx", "n_total", "n_deleted", "n_marooned")


def trial_zone(spark, d):
    return _trial(spark, d, "zone").select("p_milli", "replicate", "level", "zone_idx", "n_total", "n_deleted", "n_marooned")


def trial_zone_strict(spark, d):
    return _trial(spark, d, "zone", True).select("p_milli", "replicate", "level", "zone_idx", "n_total", "n_deleted", "n_marooned")


def trial_km(spark, d):
    return _r(_trial(spark, d, "county"), "km_total", "km_lost", digits=6).select("p_milli", "replicate", "level", "zone_idx", "km_total", "km_lost")


def trial_global(spark, d):
    net = U.network(spark, d)
    ez, zs = U.assigned(spark, d, net, ("coarse",))
    return _r(S.trials(net, ez, zs, _sc(spark))[1], "giant_frac", "second_frac").select("p_milli", "replicate", "giant_frac", "second_frac", "n_components")


def _swept(spark, d, scopes=("county", "zone")):
    net = U.network(spark, d)
    ez, zs = U.assigned(spark, d, net)
    return net, *S.sweep(net, ez, zs, _sc(spark), scopes, [0.2])


def sweep_global(spark, d):
    return _r(_swept(spark, d)[1], "frag_nominal", "frag_effective", "marooned_frac", "zone_mean_frag_effective", "giant_frac", "second_frac")


def sweep_zone_detail(spark, d):
    return _r(_swept(spark, d)[2], "frag_nominal", "frag_marooned", "frag_effective")


def _zones_at(spark, d):
    return frozen(_r(_swept(spark, d, ("county",))[2], "frag_nominal", "frag_marooned", "frag_effective"))


def rank_curves(spark, d):
    return C.rank_curves(_zones_at(spark, d)).select("level", "zone_id", "frag_effective", F.round("norm_rank", 9).alias("norm_rank"))


def curve_summary(spark, d):
    s = C.curve_summary(C.rank_curves(_zones_at(spark, d)))
    return _r(s, "median_frag", "rank_at_50pct", digits=9).withColumn("tail_slope_ols", F.round("tail_slope_ols", 6)).select("level", "n_zones", "median_frag", "rank_at_50pct", "tail_slope_ols")


def estimate_pc(spark, d):
    return _r(C.estimate_pc(_swept(spark, d, ("county",))[1]), "max_second_frac").select("level", "pc_second_peak", "max_second_frac", "pc_giant_half")


def county_summary(spark, d):
    net, g, z = _swept(spark, d, ("county",))
    s = C.county_summary(C.rank_curves(z), g, N.summary(net))
    return _r(s, "median_frag", "mean_degree", "total_km").select("fips", "level", "n_zones", "median_frag", "pc_second_peak", "pc_giant_half", "n_nodes", "n_edges", "mean_degree", "total_km")


def percolation_means(spark, d):
    m = C.percolation_means(_swept(spark, d, ("county",))[1])
    return _r(m, "giant_frac", "second_frac", "frag_effective").select("level", "p", "giant_frac", "second_frac", "frag_effective")


def _hist(spark, d):
    return P.histogram(P.cluster_sizes(U.network(spark, d), 0.4, 4), ["fips"])


def cluster_sizes(spark, d):
    return _hist(spark, d).select(F.col("size").cast("bigint").alias("size"), "n")


def ccdf(spark, d):
    return P.ccdf(_hist(spark, d), ["fips"]).select("size", F.round("ccdf", 9).alias("ccdf"))


def powerlaw_mle(spark, d):
    return _r(P.fit_powerlaw(frozen(_hist(spark, d)), ["fips"]), "alpha", "ks", digits=6).select("alpha", "xmin", "n_tail", "ks")


def fitted_tail(spark, d):
    """The fitted tail beside the cluster sizes, for plots; every size is a candidate."""
    hist = frozen(_hist(spark, d))
    return P.fitted_tail(P.fit_powerlaw(hist, ["fips"], P.candidates(hist, ["fips"], most=None)), hist, ["fips"]).select("size", F.round("fitted", 6).alias("fitted"))


def critical_exponent(spark, d):
    return _r(P.critical_exponent(U.network(spark, d), 0.4, 4), "alpha", "ks", "tau_2d_reference", digits=6).select("alpha", "xmin", "n_tail", "ks", "p", "tau_2d_reference")


def marooned_score_rank(spark, d):
    s = C.scored(_zones_at(spark, d), "medium", "county")
    return _r(s, "marooned", "score", "norm_rank", digits=6).select("zone_id", "n_edges", "marooned", "score", "rank", "norm_rank")


def score_powerfit(spark, d):
    f = C.power_fit(C.scored(_zones_at(spark, d)), ["fips", "level"])
    return _r(f, "a", "b", "r2", digits=6).select("fips", "level", "n_zones", "a", "b", "r2")


def overlay_rescale(spark, d):
    f = C.overlay(C.power_fit(C.scored(_zones_at(spark, d)), ["fips", "level"]))
    return _r(f, "a_norm", "b", digits=6).select("fips", "level", "a_norm", "b")


def restart_antijoin(spark, d):
    """Counties (nations here) still to do, given those done (with a supplier of a balance above 9000)."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips"))
    done = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 9000").select(F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("fips"))
    return nation.join(done, "fips", "left_anti")


def landed_box(spark, d):
    """The raw layer landed along a curve, and read again within a box."""
    raw = U.lattice(spark, d)
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    landing.land(raw, folder, G.bounds(F.array("geometry")))
    return landing.read_box(spark, folder, (450.0, 320.0, 1290.0, 900.0)).select("edge_id", "box_x0", "box_y0")


def touching_zones(spark, d):
    """Which zones of the medium grid the suppliers' catchments touch."""
    zones = U.zone_grid(spark, d, "medium").select(F.col("zone_id").alias("right_id"), "geometry")
    return X.touching(U.diamonds(spark, d).withColumnRenamed("id", "left_id"), zones, 400.0)


def zones_by_sides(spark, d):
    """Areas known from the two sides of each edge; border edges count by halves."""
    net = U.network(spark, d)
    ez, zones = Z.assign_by_sides(net, U.sides(net))
    n = ez.groupBy("fips", "level", "zone_idx").agg(F.sum("share").alias("n_edges"))
    return _r(zones.join(n, ["fips", "level", "zone_idx"]), "cx", "cy", digits=5).select("zone_id", "n_edges", "cx", "cy", "anchor_node")


def trial_by_sides(spark, d):
    net = U.network(spark, d)
    ez, zones = Z.assign_by_sides(net, U.sides(net))
    c = T.per_zone(frozen(D.deletions(net, _sc(spark))), ez, frozen(zones))
    return c.join(zones, ["fips", "level", "zone_idx"]).select("p_milli", "replicate", "zone_id", "n_total", "n_deleted", "n_marooned")


def conflated_ratings(spark, d):
    """The edge each rated point lies on."""
    return X.conflate(U.supplier_points(spark, d), U.network(spark, d), 40.0).select("id", "edge_id", "gap")


def delete_measured_edge(spark, d):
    """Deletion by fitness measured at points on the edges, and by class elsewhere."""
    ratings = U.supplier_points(spark, d).withColumn("rating", F.col("s_acctbal") / 10_000)
    net = frozen(X.measured_fitness(U.network(spark, d), ratings, 40.0))
    return D.deletions(net, _sc(spark, protocols=("fitness",))).where("deleted").select("p_milli", "replicate", "edge_id")


def line_measures(spark, d):
    """Lengths and halfway points of bent lines, one through each customer's orders."""
    p = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000).cast("double").alias("x"), (F.floor("o_totalprice") % 1000).cast("double").alias("y"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "x", "y"))), lambda v: F.struct(v.x.alias("x"), v.y.alias("y")))
    lines = p.groupBy("o_custkey").agg(line.alias("g")).where(F.size("g") > 1)
    mid = G.halfway(F.col("g"))
    return lines.select("o_custkey", F.size("g").alias("n"), F.round(G.line_length(F.col("g")), 5).alias("length"), F.round(mid.x, 4).alias("mid_x"), F.round(mid.y, 4).alias("mid_y"))


def projected_points(spark, d):
    """Customers' places on a map of the country, in the equal-area plane."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (-125 + F.col("c_custkey") % 590 / 10).alias("lon"), (24 + F.col("c_custkey") % 251 / 10).alias("lat"))
    a = G.albers(F.col("lon"), F.col("lat"))
    return c.select("c_custkey", F.round(a.x, 3).alias("x"), F.round(a.y, 3).alias("y"))


def _batch(spark, d):
    done = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 9500").select(U._code("s_nationkey").alias("fips"))
    codes = spark.read.parquet(f"{d}/nation.parquet").select(U._code("n_nationkey").alias("fips"))
    return county.run_batch(U.counties(spark, d), {"quarter": U.county_zones(spark, d)}, codes, done, pmedian=(), scopes=("county",), p_values=[0.2], replicates=2, cell=U.SPACING * 4)


def batch_outcomes(spark, d):
    """Every nation as a county, in one job: what became of each."""
    return _batch(spark, d)["outcomes"]


def batch_zones(spark, d):
    return _r(_batch(spark, d)["zones"], "frag_nominal", "frag_marooned", "frag_effective").select("fips", "level", "zone_id", "n_edges", "frag_nominal", "frag_marooned", "frag_effective")


def batch_global(spark, d):
    g = _batch(spark, d)["global"]
    return _r(g, "frag_nominal", "frag_effective", "giant_frac", "second_frac").select("fips", "level", "p", "replicate", "frag_nominal", "frag_effective", "giant_frac", "second_frac", "n_components")


_ALL = (
    road_filter, road_filter_main, try_numeric_nodes, self_loop_drop, degree, network_summary, node_coords, geometric_noding, components, components_keyed, giant_of_each, components_contracted,
    giant_component, restrict_giant, edge_midpoint, point_in_zone_first_match, edges_per_zone, zone_anchor, drop_small_zones, nearest_centre, nearest_of_many, pmedian,
    edge_betweenness, delete_betweenness_edge, trial_betweenness, sample_by_thresholds, sample_by_thresholds_fitness, snap_facilities, accessibility, trial_contracted,
    delete_random_edge, delete_fitness_edge, delete_random_road, delete_fitness_road, trial_county, trial_zone, trial_zone_strict, trial_km, trial_global,
    sweep_global, sweep_zone_detail, rank_curves, curve_summary, estimate_pc, county_summary, percolation_means, cluster_sizes, ccdf, powerlaw_mle, fitted_tail,
    critical_exponent, marooned_score_rank, score_powerfit, overlay_rescale, restart_antijoin, landed_box, touching_zones, zones_by_sides, trial_by_sides, conflated_ratings, delete_measured_edge, line_measures, projected_points, batch_outcomes, batch_zones, batch_global,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return sql.all_queries()
