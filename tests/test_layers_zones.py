"""Landed layers, touching polygons, points on edges, and zones known by the sides of edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfray.functions import geometry as G
from wayfray.operators import deletion as D
from wayfray.operators import touching as X
from wayfray.operators import trial as T
from wayfray.operators import zoning as Z
from wayfray.operators.components import frozen
from wayfray.sources import landing

RINGS = "array<array<struct<x:double,y:double>>>"


def scan_rows(df):
    """Rows that the scan of df gave, after running it."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            found += p.metrics().apply("numOutputRows").value()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_a_box_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [[(x := rng.uniform(-900, 900)), (y := rng.uniform(0, 500))], [x + 3, y + 3]], "t" * 40 + str(rng.random())) for i in range(40_000)]
    df = spark.createDataFrame([(i, [tuple(p) for p in g], t) for i, g, t in rows], "id long, geometry array<struct<x:double,y:double>>, t string")
    folder = str(tmp_path / "landed")
    landing.land(df, folder, G.bounds(F.array("geometry")), row_group_mb=0.1, files=4)
    box = (100.0, 100.0, 160.0, 150.0)
    few = landing.read_box(spark, folder, box)
    want = {i for i, (a, b), _ in rows if a[0] <= box[2] and b[0] >= box[0] and a[1] <= box[3] and b[1] >= box[1]}
    assert {r["id"] for r in few.select("id").collect()} == want and want
    assert scan_rows(landing.read_box(spark, folder, box).select("id")) < 40_000 / 5
    assert landing.read_box(spark, folder).count() == 40_000
    landing.land(df.limit(0), folder, G.bounds(F.array("geometry")))
    assert landing.read_box(spark, folder, box).count() == 0


def test_curve_visits_every_cell_once(spark):
    cells = spark.range(64).crossJoin(spark.range(64).withColumnRenamed("id", "y")).select(landing.curve_place(F.col("id"), F.col("y")).alias("z"))
    assert sorted(r["z"] for r in cells.collect()) == list(range(4096))
    top = spark.range(1).select(landing.curve_place(F.lit(65535), F.lit(65535)).alias("z")).first()["z"]
    assert top == 2**32 - 1


def boxes(rng, n, size):
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-200, 200), rng.uniform(-200, 200), rng.uniform(1, size), rng.uniform(1, size)
        out.append((i, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("cell", [7.0, 60.0, 5000.0])
def test_touching_polygons(spark, cell):
    rng = random.Random(2)
    a, b = boxes(rng, 50, 60), [*boxes(rng, 40, 15), (99, -300.0, -300.0, 300.0, 300.0)]
    ring = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
    df = lambda rows, p: spark.createDataFrame([(i, ring(*r)) for i, *r in rows] + [(None, None)], f"{p}_id long, geometry {RINGS}")
    want = sorted((i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if x0 <= u1 and x1 >= u0 and y0 <= v1 and y1 >= v0)
    assert sorted(map(tuple, X.touching(df(a, "left"), df(b, "right"), cell).collect())) == want


def test_boxes_that_meet_of_shapes_that_do_not(spark):
    """Two triangles on either side of a diagonal."""
    low, high = [[(0.0, 0.0), (9.0, 0.0), (0.0, 9.0), (0.0, 0.0)]], [[(10.0, 10.0), (10.0, 2.0), (2.0, 10.0), (10.0, 10.0)]]
    a = spark.createDataFrame([(1, low)], f"left_id int, geometry {RINGS}")
    b = spark.createDataFrame([(2, high), (3, low)], f"right_id int, geometry {RINGS}")
    assert [tuple(r) for r in X.touching(a, b, 4.0).collect()] == [(1, 3)]


def test_zones_of_many_counties(spark):
    ring = lambda x: [[(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0), (x, 0.0)]]
    zones = spark.createDataFrame([("z1", ring(0.0), 7), ("z2", ring(8.0), 8), ("z2", ring(500.0), 9), ("z3", ring(900.0), 1)], f"GEOID string, geometry {RINGS}, n int")
    bounds = spark.createDataFrame([("01", ring(-5.0)), ("02", ring(12.0)), ("03", ring(505.0))], f"fips string, geometry {RINGS}")
    got = X.zones_of_counties(zones, bounds, "GEOID", 20.0)
    assert {(r["fips"], r["GEOID"]) for r in got.collect()} == {("01", "z1"), ("02", "z2"), ("03", "z2")}


def roads(spark, n=60):
    rng = random.Random(5)
    rows = [("1", i, rng.randrange(30), rng.randrange(30, 60), *(rng.uniform(0, 300) for _ in range(4))) for i in range(n)] + [("1", n, 1, 31, 50.0, 50.0, 50.0, 50.0), ("2", 7, 1, 31, 0.0, 0.0, 300.0, 300.0)]
    df = spark.createDataFrame(rows, "fips string, edge_id long, src long, dst long, x0 double, y0 double, x1 double, y1 double")
    return rows, df.withColumns({"length_m": F.lit(1.0), "mtfcc": F.lit("S1400"), "road_key": F.lit("r"), "mid_x": (F.col("x0") + F.col("x1")) / 2, "mid_y": (F.col("y0") + F.col("y1")) / 2})


def test_points_on_edges(spark):
    rng = random.Random(6)
    rows, net = roads(spark)
    points = [("1", i, rng.uniform(-20, 320), rng.uniform(-20, 320)) for i in range(80)] + [("2", 900, 100.0, 103.0), ("3", 901, 0.0, 0.0), ("1", 902, None, 4.0)]

    def gap(x, y, r):
        ax, ay, bx, by = r[4:]
        long = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long)) if long else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = {}
    for f, i, x, y in points:
        near = [(round(gap(x, y, r), 6), r[1]) for r in rows if r[0] == f and x is not None and gap(x, y, r) <= 12]
        if near:
            want[i] = min(near)
    pts = spark.createDataFrame(points, "fips string, id long, x double, y double")
    for cell in (None, 5.0, 900.0):
        assert {r["id"]: (round(r["gap"], 6), r["edge_id"]) for r in X.conflate(pts, net, 12.0, cell).collect()} == want
    rated = pts.withColumn("rating", F.col("id") / 40)
    fit = {(r["fips"], r["edge_id"]): r["fitness"] for r in X.measured_fitness(net, rated, 12.0).collect()}
    assert len(fit) == len(rows)
    for r in rows:
        own = [min(1.0, i / 40) for i, (_, k) in want.items() if k == r[1] and (i == 900) == (r[0] == "2")]
        assert (fit[r[0], r[1]] is None) if not own else abs(fit[r[0], r[1]] - sum(own) / len(own)) < 1e-9


def test_zones_by_sides(spark):
    rng = random.Random(8)
    rows, net = roads(spark)
    sides = [(r[0], r[1], rng.choice(["a", "b", "c", None]), rng.choice(["a", "b", "c", None])) for r in rows[:-5]]
    ez, zones = Z.assign_by_sides(net, spark.createDataFrame(sides, "fips string, edge_id long, left string, right string"))
    name = {(r["fips"], r["zone_idx"]): r["zone_id"] for r in zones.collect()}
    total = {}
    for r in ez.collect():
        total[r["fips"], r["edge_id"]] = total.get((r["fips"], r["edge_id"]), 0) + r["share"]
        own = {z for f, k, *both in sides if (f, k) == (r["fips"], r["edge_id"]) for z in both} - {None}
        assert (r["zone_idx"] is None) if not own else name[r["fips"], r["zone_idx"]] in own and r["share"] == 1 / len(own)
    assert total == {(r[0], r[1]): 1.0 for r in rows}
    gone = frozen(D.deletions(net, D.scenarios(spark, [0.3], 1)))
    c = T.per_zone(gone, ez, frozen(zones))
    known = len([1 for s in sides if s[2] or s[3]])
    assert c.agg(F.sum("n_total")).first()[0] == known
    assert c.where("n_deleted + n_marooned > n_total").isEmpty()
    assert not zones.where("anchor_node is null").count()
