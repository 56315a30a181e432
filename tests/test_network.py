"""Hand-worked graphs, invariants of trials and sweeps, geometry, sources."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayfray.functions import geometry as G
from wayfray.operators import curves as C
from wayfray.operators import deletion as D
from wayfray.operators import network as N
from wayfray.operators import powerlaw as P
from wayfray.operators import sweep as S
from wayfray.operators import trial as T
from wayfray.operators import zoning as Z
from wayfray.operators.components import frozen, keyed_components, star_components
from wayfray.plans import county
from wayfray.sources import layers as L

RAW = "edge_id long, fips string, TNIDF string, TNIDT string, ROADFLG string, MTFCC string, LINEARID string, geometry array<struct<x:double,y:double>>"


def town(spark, blocks=8, side=100.0, gap=0.2):
    """Streets (east to west) and avenues (north to south) between corners ``side`` apart; a share ``gap`` of the stretches between corners is missing, by checksum."""
    corner = lambda street, avenue: 1000 * (street + 1) + avenue
    stretches = [(f"street {s}", (s, a), (s, a + 1)) for s in range(blocks + 1) for a in range(blocks)] + [(f"avenue {a}", (s, a), (s + 1, a)) for a in range(blocks + 1) for s in range(blocks)]
    rows = []
    for name, one, two in stretches:
        key = f"{corner(*one)}-{corner(*two)}"
        if zlib.crc32(key.encode()) % 1000 >= 1000 * gap:
            rows.append((len(rows), "1", str(corner(*one)), str(corner(*two)), "y", "S1400", name, [(a * side, s * side) for s, a in (one, two)]))
    return spark.createDataFrame(rows, RAW)


def squares(spark, n, extent):
    """n by n square zones named by their place in reading order."""
    step = extent / n
    rows = []
    for k in range(n * n):
        west, south = k % n * step, k // n * step
        rows.append((f"zone{k:03d}", [[(west, south), (west, south + step), (west + step, south + step), (west + step, south), (west, south)]]))
    return spark.createDataFrame(rows, "GEOID string, geometry array<array<struct<x:double,y:double>>>")


@pytest.fixture(scope="module")
def county1(spark):
    net = frozen(N.build_network(town(spark)))
    zs = Z.number_zones(squares(spark, 3, 800.0), "coarse", "1")
    ez, zones = Z.assign_by_polygons(net, zs, cell=300.0)
    return net, frozen(ez), frozen(zones)


# ---- filters -------------------------------------------------------------------------------------------------------

def test_filters(spark):
    raw = spark.createDataFrame([(1, "Y", "S1400", "1", "2"), (2, "n", "S1400", "1", "2"), (3, "y", "S1730", "2", "3"), (4, None, "S1400", "1", "2"), (5, "Y", "S1100", "x", "2"), (6, "Y", "S1100", "4", "4")], "edge_id int, ROADFLG string, MTFCC string, TNIDF string, TNIDT string")
    ids = lambda df: sorted(r["edge_id"] for r in df.collect())
    assert ids(N.road_filter(raw)) == [1, 5, 6] and ids(N.road_filter(raw, "all")) == [1, 3, 5, 6] and ids(N.road_filter(raw, "arterial")) == [5, 6]
    assert ids(N.road_filter(raw.drop("ROADFLG"))) == [1, 2, 4, 5, 6]
    assert ids(N.id_nodes(raw)) == [1, 2, 3, 4, 6] and ids(N.drop_self_loops(N.id_nodes(raw))) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        N.road_filter(raw, "nonsense")


def test_empty_network_is_an_error(spark):
    with pytest.raises(ValueError):
        N.build_network(town(spark).where("false"))


# ---- components and trials -----------------------------------------------------------------------------------------

def test_components_agree(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(60), rng.randrange(60)) for g in range(3) for _ in range(45)]
    e = spark.createDataFrame(rows, "g int, src long, dst long")
    a = sorted(map(tuple, star_components(e, ["g"]).collect()))
    assert a == sorted(map(tuple, keyed_components(e, ["g"]).collect())) and a
    path = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["label"] for r in star_components(path).collect()} == {0}


def micro(spark, edges, gone, zone_of, anchors, fips="1"):
    """Edges {id: (src, dst)} under one scenario."""
    rows = [(fips, k, a, b, 100.0, "random", "edge", 0.5, 500, 0, k in gone) for k, (a, b) in edges.items()]
    deleted = spark.createDataFrame(rows, "fips string, edge_id long, src long, dst long, length_m double, protocol string, unit string, p double, p_milli int, replicate int, deleted boolean")
    ez = spark.createDataFrame([(fips, "v", k, zone_of.get(k)) for k in edges], "fips string, level string, edge_id long, zone_idx int")
    zs = spark.createDataFrame([(fips, "v", z, f"Z{z}", n) for z, n in anchors.items()], "fips string, level string, zone_idx int, zone_id string, anchor_node long")
    return deleted, ez, zs


def counts(df):
    return {r["zone_idx"]: (r["n_total"], r["n_deleted"], r["n_marooned"]) for r in df.collect()}


def test_path_and_diagnostics(spark):
    d, ez, zs = micro(spark, {1: (1, 2), 2: (2, 3), 3: (3, 4)}, {2}, {1: 0, 2: 0, 3: 0}, {0: 1})
    r = T.per_zone(d, ez, zs).first()
    assert (r["n_total"], r["n_deleted"], r["n_marooned"], r["km_total"], r["km_lost"]) == (3, 1, 1, 0.3, 0.2)
    g = T.diagnostics(d, T.surviving_labels(d)).first()
    assert (g["giant_frac"], g["second_frac"], g["n_components"]) == (0.5, 0.5, 2)


def test_cycle_detour_lost_anchor_leak_all_deleted(spark):
    square = {1: (1, 2), 2: (2, 3), 3: (3, 4), 4: (4, 1)}
    assert counts(T.per_zone(*micro(spark, square, {2}, dict.fromkeys(square, 0), {0: 1}))) == {0: (4, 1, 0)}
    detour = micro(spark, square, {1}, {1: 0, 2: 0, 3: 1, 4: 1}, {0: 1, 1: 4})
    assert counts(T.per_zone(*detour)) == {0: (2, 1, 0), 1: (2, 0, 0)}
    assert counts(T.per_zone(*detour, scope="zone")) == {0: (2, 1, 1), 1: (2, 0, 0)}
    assert counts(T.per_zone(*micro(spark, {1: (1, 2), 2: (2, 3)}, {1}, {1: 0, 2: 0}, {0: 1}))) == {0: (2, 1, 1)}
    leak = micro(spark, {1: (1, 2), 2: (2, 3), 3: (1, 3)}, {1}, {1: 0, 2: 0}, {0: 1})
    assert counts(T.per_zone(*leak, scope="zone")) == {0: (2, 1, 0)}
    assert counts(T.per_zone(*leak, scope="zone", strict=True)) == {0: (2, 1, 1)}
    gone = micro(spark, square, set(square), dict.fromkeys(square, 0), {0: 1})
    assert counts(T.per_zone(*gone)) == {0: (4, 4, 0)}
    g = T.diagnostics(gone[0], T.surviving_labels(gone[0])).first()
    assert (g["giant_frac"], g["second_frac"], g["n_components"]) == (0.0, 0.0, 0)


def test_zones_and_extremes(county1, spark):
    net, ez, zones = county1
    m = net.count()
    degrees = N.summary(net).first()
    assert 2.0 < degrees["mean_degree"] < 4.1 and degrees["n_edges"] == m
    assert ez.where("zone_idx is not null").count() <= m and ez.count() == m
    gone = frozen(D.deletions(net, D.scenarios(spark, [0.0, 1.0], 1)))
    by = {(r["p"], r["zone_idx"]): r for r in T.per_zone(gone, ez, zones).collect()}
    for (p, _), r in by.items():
        assert r["n_deleted"] == (r["n_total"] if p else 0) and r["n_marooned"] == 0
    g = {r["p"]: r["giant_frac"] for r in T.diagnostics(gone, T.surviving_labels(gone)).collect()}
    assert g == {0.0: 1.0, 1.0: 0.0}


def test_units_and_protocols(county1, spark):
    net, _, _ = county1
    m, p = net.count(), 0.2
    n = {(r["protocol"], r["unit"]): r["n"] for r in D.deletions(net, D.scenarios(spark, [p], 1, ("random", "fitness"), ("edge", "road"))).groupBy("protocol", "unit").agg(F.count_if("deleted").alias("n")).collect()}
    assert n[("random", "edge")] == n[("fitness", "edge")] == round(p * m)
    assert 0 < n[("random", "road")] <= max(round(p * m), 15) and n[("fitness", "road")] > 0
    roads = D.delete_roads(net, D.scenarios(spark, [p], 1, units=("road",))).groupBy("road_key").agg(F.countDistinct("deleted").alias("k")).collect()
    assert {r["k"] for r in roads} == {1}


def test_road_prefix_and_overshoot(spark):
    def net(sizes):
        rows = [("1", k, 1.0, "S1400", road) for k, road in enumerate(r for r, n in sizes.items() for _ in range(n))]
        return spark.createDataFrame(rows, "fips string, edge_id long, length_m double, mtfcc string, road_key string")

    for sizes in ({"a": 3, "b": 4, "c": 1, "d": 2}, {"a": 9, "b": 1}):
        total = sum(sizes.values())
        sc = D.scenarios(spark, [0.5], 6, units=("road",))
        for r in D.delete_roads(net(sizes), sc).where("deleted").groupBy("replicate").agg(F.count("*").alias("n"), F.countDistinct("road_key").alias("k")).collect():
            assert r["n"] <= round(0.5 * total) or r["k"] == 1


def test_weighted_sample_prefers_unfit(spark):
    net = spark.range(2000).select(F.lit("1").alias("fips"), F.col("id").alias("edge_id"), F.lit(1.0).alias("length_m"), F.when(F.col("id") % 2 == 0, "S1100").otherwise("S1500").alias("mtfcc"), F.lit("r").alias("road_key"))
    n = {r["mtfcc"]: r["n"] for r in D.delete_edges(net, D.scenarios(spark, [0.2], 1, ("fitness",))).where("deleted").groupBy("mtfcc").agg(F.count("*").alias("n")).collect()}
    assert n["S1500"] > 6 * n["S1100"] and sum(n.values()) == 400


def test_zone_scope_maroons_more(county1, spark):
    net, ez, zones = county1
    gone = frozen(D.deletions(net, D.scenarios(spark, [0.2, 0.4], 2)))
    a = {(r["p"], r["replicate"], r["zone_idx"]): r for r in T.per_zone(gone, ez, zones).collect()}
    b = {(r["p"], r["replicate"], r["zone_idx"]): r for r in T.per_zone(gone, ez, zones, "zone").collect()}
    assert a.keys() == b.keys() and all(b[k]["n_marooned"] >= a[k]["n_marooned"] and b[k]["n_total"] == a[k]["n_total"] for k in a)


def test_sweep_and_summaries(county1, spark):
    net, ez, zones = county1
    glob, zone = S.sweep(net, ez, zones, D.scenarios(spark, [0.05, 0.2, 0.5], 3), ("county", "zone"), [0.2])
    g = glob.collect()
    assert len(g) == 2 * 3 * 3 and all(r["giant_frac"] is None for r in g if r["scope"] == "zone")
    mean = lambda p: sum(r["giant_frac"] for r in g if r["p"] == p and r["scope"] == "county") / 3
    assert mean(0.05) > mean(0.5)
    curves = C.rank_curves(zone)
    s = C.county_summary(curves, glob, N.summary(net)).collect()
    assert {r["scope"] for r in s} == {"county", "zone"} and all((r["pc_second_peak"] is None) == (r["scope"] == "zone") for r in s)
    assert C.estimate_pc(glob.where("scope = 'zone'")).count() == 0
    assert C.rank_curves(zone, 0.77).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_one_pass_is_the_joined_path(county1, spark, strict):
    """Counties that fit a task are counted over arrays, others by joins and distributed components: the same tables."""
    net, ez, zones = county1
    other = Z.assign_by_polygons(net, Z.number_zones(squares(spark, 2, 700.0), "part of it", "1"), cell=300.0)
    ez, zones = (frozen(x) for x in Z.all_levels([(ez, zones), other]))
    sc = D.scenarios(spark, [0.0, 0.3, 1.0], 2, ("random", "fitness"), ("edge", "road"))
    one, two = (S.sweep(net, ez, zones, sc, ("county", "zone"), [0.3], strict, per_task=n) for n in (10**6, 1))
    for a, b in zip(one, two, strict=True):
        row = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert a.dtypes == b.dtypes and row(a) == row(b) and row(a)


def test_large_node_ids_in_one_pass(spark):
    """Ids beyond 2 ** 53 differ in their last digit only, and a zone has no anchor."""
    top = 2**60
    net = spark.createDataFrame([("1", k, top + k, top + k + 1, 10.0, "S1400", "r") for k in range(6)], "fips string, edge_id long, src long, dst long, length_m double, mtfcc string, road_key string")
    ez = spark.createDataFrame([("1", "v", k, k // 3) for k in range(6)], "fips string, level string, edge_id long, zone_idx int")
    zs = spark.createDataFrame([("1", "v", 0, "a", top + 1), ("1", "v", 1, "b", None)], "fips string, level string, zone_idx int, zone_id string, anchor_node long")
    sc = D.scenarios(spark, [0.0, 0.5], 2)
    row = lambda n: sorted(map(str, S.trials(net, ez, zs, sc, ("county", "zone"), per_task=n)[0].select(*T.KEYS, "scope", "zone_idx", "n_deleted", "n_marooned").collect()))
    assert row(10**6) == row(1)


def test_number_of_scenarios_is_checked(spark):
    with pytest.raises(ValueError):
        D.scenarios(spark, [1.5], 1)
    with pytest.raises(ValueError):
        D.scenarios(spark, [0.5], 1, ("other",))
    assert D.p_grid("0.1:0.3:0.1") == [0.1, 0.2, 0.3] and D.p_grid("0.2,0.5") == [0.2, 0.5]


# ---- zones ---------------------------------------------------------------------------------------------------------

def test_border_midpoints_go_to_the_first_zone(spark):
    net = spark.createDataFrame([("1", 1, 400.0, 100.0), ("1", 2, 100.0, 100.0), ("1", 3, 9000.0, 0.0)], "fips string, edge_id long, mid_x double, mid_y double")
    zs = Z.number_zones(squares(spark, 2, 800.0), "v", "1")
    assert {r["edge_id"]: r["zone_idx"] for r in Z.point_in_zone(net, zs, 150.0).collect()} == {1: 0, 2: 0, 3: None}


def test_small_zones_go_but_edges_stay(county1, spark):
    net, _, _ = county1
    ez, zones = Z.assign_by_polygons(net, Z.number_zones(squares(spark, 8, 800.0), "fine", "1"), 300.0)
    n = Z.edges_per_zone(ez).collect()
    assert all(r["n_edges"] >= 5 for r in n) and ez.count() == net.count()
    assert sorted(r["zone_idx"] for r in zones.collect()) == list(range(zones.count()))


def test_pmedian_covers_all(county1):
    net, _, _ = county1
    ez, zones = Z.assign_by_pmedian(net, 3)
    assert ez.where("zone_idx is null").count() == 0 and zones.count() == 3 and zones.where("anchor_node is null").count() == 0


def test_zone_layer_selection(spark):
    polys = squares(spark, 2, 2.0).withColumns({"STATEFP": F.lit("18"), "COUNTYFP": F.when(F.col("GEOID") == "zone000", "097").otherwise("001")})
    assert Z.select_zone_polygons(polys, "tract", "18097").count() == 1
    edge = spark.createDataFrame([([[(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)]],)], "geometry array<array<struct<x:double,y:double>>>")
    assert [r["GEOID"] for r in Z.select_zone_polygons(polys, "zcta", "18097", edge).collect()] == ["zone000"]
    with pytest.raises(KeyError):
        Z.select_zone_polygons(polys.drop("STATEFP"), "bg", "18097")
    with pytest.raises(ValueError):
        Z.select_zone_polygons(polys, "parish", "18097")


# ---- geometry ------------------------------------------------------------------------------------------------------

def test_geometry(spark):
    line = "array(named_struct('x',0d,'y',0d), named_struct('x',3d,'y',4d), named_struct('x',3d,'y',9d))"
    hole = "array(array(named_struct('x',0d,'y',0d),named_struct('x',4d,'y',0d),named_struct('x',4d,'y',4d),named_struct('x',0d,'y',4d),named_struct('x',0d,'y',0d)),array(named_struct('x',1d,'y',1d),named_struct('x',1d,'y',2d),named_struct('x',2d,'y',2d),named_struct('x',2d,'y',1d),named_struct('x',1d,'y',1d)))"
    df = spark.sql(f"select {line} l, {hole} g")
    inside = lambda x, y: G.contains(F.col("g"), F.lit(x), F.lit(y))
    r = df.select(G.line_length(F.col("l")).alias("n"), G.halfway(F.col("l")).alias("h"), G.centroid(F.col("g")).alias("c"), inside(0.0, 2.0).alias("border"), inside(3.0, 3.0).alias("in"), inside(1.5, 1.5).alias("hole"), inside(5.0, 1.0).alias("out"), G.bounds(F.col("g")).alias("b")).first()
    assert r["n"] == 10 and tuple(r["h"]) == (3.0, 4.0) and tuple(r["b"]) == (0, 0, 4, 4)
    assert math.isclose(r["c"]["x"], (32 - 1.5) / 15) and (r["border"], r["in"], r["hole"], r["out"]) == (True, True, False, False)


def test_projection(spark):
    r = spark.range(1).select(G.albers(F.lit(-96.0), F.lit(23.0)).alias("o"), G.albers(F.lit(-86.158), F.lit(39.768)).alias("i")).first()
    assert abs(r["o"]["x"]) < 1e-6 and abs(r["o"]["y"]) < 1e-6
    assert 830_000 < r["i"]["x"] < 850_000 and 1_880_000 < r["i"]["y"] < 1_930_000


# ---- statistics ----------------------------------------------------------------------------------------------------

def brute_powerlaw(x):
    x = sorted(x)
    if len(x) < 20:
        return None, None, 0, None
    u = sorted(set(x))[:-10]
    if len(u) > 200:
        u = [u[math.floor(i * (len(u) - 1) / 199)] for i in range(200)]
    best = (math.inf, None, None, 0)
    for m in u:
        t = [v for v in x if v >= m]
        if len(t) < 20:
            continue
        a = 1 + len(t) / sum(math.log(v / (m - 0.5)) for v in t)
        ks = max(abs(i / len(t) - (1 - (v / (m - 0.5)) ** (1 - a))) for i, v in enumerate(t))
        if ks < best[0] - 1e-15:
            best = (ks, m, a, len(t))
    return best[2], best[1], best[3], best[0]


@pytest.mark.parametrize("n", [10, 80, 900])
def test_powerlaw(spark, n):
    rng = random.Random(n)
    x = [int(rng.paretovariate(1.1)) for _ in range(n)]
    h = P.histogram(spark.createDataFrame([("1", v) for v in x], "fips string, size long"), ["fips"])
    r = P.fit_powerlaw(h, ["fips"]).first()
    a, m, k, ks = brute_powerlaw(x)
    assert r["n_tail"] == k and r["xmin"] == m
    if a is not None:
        assert math.isclose(r["alpha"], a, rel_tol=1e-9) and math.isclose(r["ks"], ks, rel_tol=1e-9)


def test_fitted_tail_tries_every_size(spark, monkeypatch):
    """Of 231 candidate sizes the best start of the tail is one that an even choice of 200 leaves out."""
    from wayfray.plans import queries

    rng = random.Random(6)
    x = [int(rng.paretovariate(0.6)) for _ in range(2500)]
    u, total = sorted(set(x))[:-10], len(x)
    best = (math.inf, None, None, 0)
    for m in u:
        t = sorted(v for v in x if v >= m)
        if len(t) >= 20:
            a = 1 + len(t) / sum(math.log(v / (m - 0.5)) for v in t)
            best = min(best, (max(abs(i / len(t) - (1 - (v / (m - 0.5)) ** (1 - a))) for i, v in enumerate(t)), m, a, len(t)))
    _, m, a, k = best
    assert len(u) > 200 and m not in {u[i * (len(u) - 1) // 199] for i in range(200)}
    monkeypatch.setattr(queries, "_hist", lambda spark, d: P.histogram(spark.createDataFrame([("1", v) for v in x], "fips string, size long"), ["fips"]))
    got = {r["size"]: r["fitted"] for r in queries.fitted_tail(spark, "").collect()}
    assert got.keys() == {v for v in x if v >= m}
    assert all(abs(got[v] - k / total * (v / m) ** (1 - a)) < 2e-6 for v in got)


def test_scores_and_fit(spark):
    rows = [("1", "v", "county", f"Z{k}", 100, 0.002 * k**1.5) for k in range(1, 30)] + [("2", "v", "county", "Z", 10, 0.0)]
    z = spark.createDataFrame(rows, "fips string, level string, scope string, zone_id string, n_edges long, frag_marooned double")
    scored, fits = county.postprocess(z, "v")
    f = fits.collect()
    assert len(f) == 1 and math.isclose(f[0]["b"], 1.5, rel_tol=1e-9) and math.isclose(f[0]["a"], 2.0, rel_tol=1e-9) and math.isclose(f[0]["r2"], 1.0)
    assert scored.where("fips = '1'").agg(F.max("norm_rank")).first()[0] == 1.0
    old = z.withColumnRenamed("frag_marooned", "frag_effective")
    assert C.scored(old).agg(F.max("score")).first()[0] == z.agg(F.max("frag_marooned") * 1000).first()[0]


# ---- sources and batches -------------------------------------------------------------------------------------------

def test_addresses():
    assert L.build_url("edges", 1001).endswith("/EDGES/tl_2025_01001_edges.zip") and L.build_url("tract", "18097", 2024).endswith("2024/TRACT/tl_2024_18_tract.zip")
    assert L.build_url("zcta").endswith("tl_2025_us_zcta520.zip")
    with pytest.raises(KeyError):
        L.build_url("rivers", "18097")
    with pytest.raises(ValueError):
        L.build_url("edges")


def test_shapefile(spark, tmp_path):
    lines = [[[(0.0, 0.0), (1.0, 2.0)]], [[(5.0, 5.0), (6.0, 7.0)], [(8.0, 8.0), (9.0, 9.0)]], None]
    shp, shx, at = b"", b"", 50
    for k, parts in enumerate(lines):
        if parts is None:
            body = struct.pack("<i", 0)
        else:
            pts = [p for part in parts for p in part]
            starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            body = struct.pack("<i4d2i", 3, min(xs), min(ys), max(xs), max(ys), len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    (tmp_path / "e.shp").write_bytes(bytes(100) + shp)
    (tmp_path / "e.shx").write_bytes(bytes(100) + shx)
    fields = [("NAME", b"C", 6, 0), ("TNIDF", b"N", 5, 0), ("LEN", b"N", 6, 2)]
    head = struct.pack("<4BIHH20x", 3, 125, 1, 1, 3, 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    desc = b"".join(struct.pack("<11sc4xBB14x", n.encode(), t, w, d) for n, t, w, d in fields)
    recs = b"".join(b" " + n.ljust(6).encode() + v.rjust(5).encode() + x.rjust(6).encode() for n, v, x in (("Elm", "12", "1.50"), ("", "x", "2.00"), ("Oak", "7", "")))
    (tmp_path / "e.dbf").write_bytes(head + desc + b"\x0d" + recs)
    from wayfray.sources import shapefile

    shapefile.register(spark)
    df = spark.read.format("shapefile").option("records", 2).load(str(tmp_path / "e.shp"))
    assert [(r["NAME"], r["TNIDF"], r["LEN"], r["parts"] and len(r["parts"])) for r in df.collect()] == [("Elm", 12, 1.5, 1), (None, None, 2.0, 2), ("Oak", 7, None, None)]
    few = spark.read.format("shapefile").option("bbox", "4,4,10,10").option("columns", "TNIDF").load(str(tmp_path / "e.shp"))
    assert few.columns == ["TNIDF", "parts"] and few.count() == 1


def test_batches_restart_and_isolate(spark, tmp_path):
    loaded = []

    def load(spark, code, **_):
        loaded.append(code)
        if code == "00003":
            raise FileNotFoundError("no such layer")
        raw = town(spark, 4).withColumns({"fips": F.lit(code), "MTFCC": F.when(F.lit(code) == "00004", "S1740").otherwise(F.col("MTFCC"))})
        if code == "00005":
            raw = raw.withColumn("edge_id", F.expr("raise_error('broken file')").cast("long"))
        return raw, {"quarter": squares(spark, 2, 400.0).withColumn("fips", F.lit(code))}

    out, kw = str(tmp_path / "r"), {"load": load, "project": False, "pmedian": (), "scopes": ("county",), "p_values": [0.3], "replicates": 2, "detail": (0.3,), "cell": 150.0}
    asked = [1, "2", 3, "00004", 5]
    got = {r["fips"]: (r["outcome"], r["reason"]) for r in county.run_many(spark, asked, out, **kw).collect()}
    assert got["00001"][0] == got["00002"][0] == "done" and got["00004"] == ("failed", "no road of the set")
    assert got["00003"][0] == got["00005"][0] == "failed" and "no such layer" in got["00003"][1]
    assert L.discover_fips(spark, out, "summary") == ["00001", "00002"]
    del loaded[:]
    got = {r["fips"]: r["outcome"] for r in county.run_many(spark, asked, out, **kw).collect()}
    assert got["00001"] == got["00002"] == "skipped" and loaded == ["00003", "00004", "00005"]
    del loaded[:]
    county.run_many(spark, [1], out, **{**kw, "replicates": 3})
    assert loaded == ["00001"]  # other settings, so done again
    one = county.run_county(spark, "2", load=load, **{k: v for k, v in kw.items() if k != "load"}, roads="all")
    assert one["summary"].count() == 1


def test_batch_is_the_sum_of_its_counties(spark):
    raw = town(spark, 5)
    zones = squares(spark, 2, 500.0)
    two = raw.withColumn("fips", F.lit("2")).where("edge_id % 9 <> 0")
    kw = {"pmedian": (2,), "scopes": ("county",), "p_values": [0.2], "replicates": 2, "cell": 200.0}
    both = county.run_batch(raw.unionByName(two), {"q": zones.withColumn("fips", F.explode(F.array(F.lit("1"), F.lit("2"))))}, **kw)
    row = lambda df: sorted(map(str, df.select("fips", "level", "zone_id", "n_edges", F.round("frag_effective", 9)).collect()))
    apart = [county.run_batch(r, {"q": zones.withColumn("fips", F.lit(f))}, **kw) for f, r in (("1", raw), ("2", two))]
    assert row(both["zones"]) == row(apart[0]["zones"].unionByName(apart[1]["zones"]))
    assert {(r["fips"], r["level"], r["outcome"]) for r in both["outcomes"].collect()} == {(f, v, "done") for f in "12" for v in ("q", "pmedian2")}
    done = spark.createDataFrame([("2",)], "fips string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "fips string")
    some = county.run_batch(raw.unionByName(two), {"q": zones.withColumn("fips", F.lit("1"))}, asked, done, **{**kw, "pmedian": ()})
    assert {r["fips"]: (r["outcome"], r["reason"]) for r in some["outcomes"].collect() if r["fips"] != "1"} == {"2": ("skipped", "done before"), "3": ("failed", "no edge layer")}
    assert row(some["zones"]) == row(apart[0]["zones"].where("level = 'q'"))


def test_pmedian_of_many_centres_and_counties(spark):
    """By cells as packed, and by county as alone."""
    net = frozen(N.build_network(town(spark, 6)))
    pts = net.select("fips", "edge_id", "mid_x", "mid_y")
    rng = random.Random(5)
    centres = spark.createDataFrame([("1", i, rng.uniform(0, 600), rng.uniform(0, 600)) for i in range(40)], "fips string, zone_idx int, x double, y double")
    a, b = (sorted((r["edge_id"], r["zone_idx"]) for r in Z.nearest_centre(pts, centres, c).collect()) for c in (None, 30.0))
    assert a == b and len(a) == net.count()
    other = net.withColumns({"fips": F.lit("2"), "mid_x": F.col("mid_x") + 7000})
    ez, zones = Z.assign_by_pmedian(net.unionByName(other), 4)
    one, _ = Z.assign_by_pmedian(net, 4)
    assert sorted(map(tuple, ez.where("fips = '1'").collect())) == sorted(map(tuple, one.collect())) and zones.count() == 8


def test_edge_ids_of_layers(spark):
    """Ids come from the layer's own, or from what a row holds: not from how its file is split."""
    rows = [("17", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]), ("18", [[(0.0, 0.0), (1.0, 1.0)]])]
    df = spark.createDataFrame(rows, "TLID string, parts array<array<struct<x:double,y:double>>>")
    ids = lambda d: [r[0] for r in d.select("*", F.posexplode("parts").alias("_part", "geometry")).drop("parts").select(L.edge_id([c for c in d.columns])).collect()]
    assert ids(df) == [17000, 17001, 18000]
    a, b = ids(df.withColumnRenamed("TLID", "NAME")), ids(df.withColumnRenamed("TLID", "NAME").repartition(3))
    assert len(set(a)) == 3 and set(a) == set(b)


def test_geometric_noding(spark):
    e = N.grid_nodes(town(spark).drop("TNIDF", "TNIDT"), 1.0)
    a, b = N.degree(N.measured(N.drop_self_loops(e))), N.degree(N.build_network(town(spark), giant_only=False))
    assert sorted(r["degree"] for r in a.collect()) == sorted(r["degree"] for r in b.collect())


def test_run_layers(spark):
    out = county.run_layers(town(spark, 6), {"coarse": squares(spark, 2, 600.0)}, "1", pmedian=(2,), p_values=[0.2, 0.4], replicates=2, cell=300.0)
    assert {r["level"] for r in out["summary"].collect()} == {"coarse", "pmedian2"}
    assert set(out["global"].columns) >= {"label", "fips", "n_components"}
