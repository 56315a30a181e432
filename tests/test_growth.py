"""Steps whose cost must not grow faster than their input."""

import random

from pyspark.sql import functions as F

from wayfray.operators import components as K
from wayfray.operators import nearest
from wayfray.operators import zoning as Z


def test_contraction_needs_no_star_rounds_on_a_strip(spark, monkeypatch):
    """Neighbours meet in a task whatever the order of the rows, so that few links are left and none goes through rounds."""
    def rounds(*args, **kw):
        raise AssertionError("star rounds")

    monkeypatch.setattr(K, "star_components", rounds)
    rows = [(s, i, i + 1) for s in range(2) for i in range(6000) if i % 1500 != 7 * s]
    random.Random(1).shuffle(rows)
    e = spark.createDataFrame(rows, "s int, src long, dst long").repartition(6)
    found = {(r["s"], r["node"]): r["label"] for r in K.contracted_components(e, ["s"], 500).collect()}
    want = sorted(map(tuple, K.keyed_components(e, ["s"]).collect()))
    assert sorted((s, n, v) for (s, n), v in found.items()) == want


def test_a_large_graph_is_not_one_task(spark, monkeypatch):
    """A graph of 300,000 edges is contracted by default; the labels are those of one task."""
    sizes = []
    own = K.keyed_components
    monkeypatch.setattr(K, "keyed_components", lambda edges, by: (sizes.append(edges.count()), own(edges, by))[1])
    e = spark.range(300_000).select(F.lit("a").alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src % 1000 <> 0")
    got = K.components(e, ["g"]).groupBy("label").count()
    assert got.count() == 300 and got.where("count <> 1000").count() == 0
    assert sizes and max(sizes) < 1000


def test_targets_in_one_place_are_met_once(spark, monkeypatch):
    met = []
    own = nearest.frozen
    monkeypatch.setattr(nearest, "frozen", lambda df: (met.append((df.columns, df.count())), own(df))[1])
    points = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(0.0).alias("y"))
    targets = spark.range(400).select((F.col("id") + 5).alias("target"), (F.col("id") % 2 * 6).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = {r["id"]: (r["target"], r["gap"]) for r in nearest.nearest_join(points, targets, 4.0).collect()}
    assert got == {i: (5, float(i % 7)) if i % 7 <= 3 else (6, 6.0 - i % 7) for i in range(50)}
    assert [n for columns, n in met if "target" in columns and "gap" not in columns] == [2]


def test_points_stay_where_they_are_for_a_handful_of_centres(spark):
    """A round over a county's points doesn't gather them by county."""
    points = spark.createDataFrame([("1", i, float(i), 0.0) for i in range(100)], "fips string, edge_id long, mid_x double, mid_y double")
    centres = spark.createDataFrame([("1", 0, 20.0, 0.0), ("1", 1, 80.0, 0.0)], "fips string, zone_idx int, x double, y double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = Z.nearest_centre(points, centres)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["zone_idx"]: r["count"] for r in near.groupBy("zone_idx").count().collect()} == {0: 51, 1: 49}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_betweenness_of_a_county_of_a_million_edges_is_dealt_by_sources(spark, monkeypatch):
    """Two sources a task, each row of a task an edge alone; no joins by levels."""
    from wayfray.operators import betweenness as B

    def levels(*args, **kw):
        raise AssertionError("joins by levels")

    monkeypatch.setattr(B, "levels_betweenness", levels)
    n = 1_000_100
    star = spark.range(n).select(F.lit("1").alias("fips"), F.col("id").alias("edge_id"), F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    got = B.edge_betweenness(star, 2)
    low, high, total = got.agg(F.min("betweenness"), F.max("betweenness"), F.count("*")).first()
    scale = (n + 1) / 2
    assert total == n and abs(low - 2 * scale) < 1e-3 and abs(high - (n + 1) * scale) < 1e-3 * scale


def test_betweenness_of_a_county_of_millions_of_edges_is_not_joined_by_levels(spark, monkeypatch):
    """Above 1,500,000 edges sources are dealt to tasks too."""
    from wayfray.operators import betweenness as B

    def levels(*args, **kw):
        raise AssertionError("joins by levels")

    monkeypatch.setattr(B, "levels_betweenness", levels)
    n = 1_600_000
    star = spark.range(n).select(F.lit("1").alias("fips"), F.col("id").alias("edge_id"), F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    got = B.edge_betweenness(star, 1)
    assert got.agg(F.count("*"), F.countDistinct("edge_id")).first() == (n, n)
    assert B.PER_TASK >= 6_600_000


def test_paths_beyond_a_double_are_counted():
    """A full grid of 1,100 by 1,100 has up to 10 ** 660 shortest paths; dependencies sum up to the depths of all nodes."""
    import numpy as np

    from wayfray.operators import betweenness as B

    w = 1100
    f = np.arange(w * w)
    a, b = f[f % w + 1 < w], f[f + w < w * w]
    got = B.dependencies(np.concatenate([a, b]), np.concatenate([a + 1, b + w]), np.array([0]))
    assert np.isfinite(got).all() and abs(got.sum() - (f % w + f // w).sum()) < 1
