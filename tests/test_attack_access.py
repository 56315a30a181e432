"""Targeted attack, sampling by thresholds, contracted components, nearest targets and accessibility, each against brute force."""

import heapq
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wayfray.operators import access as A
from wayfray.operators import betweenness as B
from wayfray.operators import deletion as D
from wayfray.operators import trial as T
from wayfray.operators.components import components, contracted_components, frozen, keyed_components
from wayfray.operators.nearest import nearest_join

NET = "fips string, edge_id long, src long, dst long, length_m double, mtfcc string, road_key string, x0 double, y0 double, x1 double, y1 double"


def tangle(seed, fips, nodes, edges):
    """A random multigraph with loops, parallel edges and several components."""
    rng = random.Random(seed)
    at = {n: (rng.uniform(0, 900), rng.uniform(0, 900)) for n in range(nodes)}
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    return [(fips, k, a, b, float(rng.randrange(1, 50)), rng.choice(["S1100", "S1400", None]), f"road {k % 9}", *at[a], *at[b]) for k, (a, b) in enumerate(pairs)]


@pytest.fixture(scope="module")
def nets(spark):
    rows = tangle(1, "01", 60, 90) + tangle(2, "02", 25, 40) + [("03", 7, 3, 4, 2.0, None, None, 0.0, 0.0, 1.0, 1.0)]
    return rows, frozen(spark.createDataFrame(rows, NET))


def scored(rows, fips):
    """Edge betweenness by listing every shortest path."""
    own = [r for r in rows if r[0] == fips]
    near = {}
    for _, k, a, b, *_ in own:
        near.setdefault(a, [])
        near.setdefault(b, [])
        if a != b:
            near[a].append((b, k))
            near[b].append((a, k))
    out = {r[1]: 0.0 for r in own}
    for s in near:
        d, q = {s: 0}, deque([s])
        while q:
            x = q.popleft()
            for y, _ in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)

        def paths(t, s=s, d=d):
            return [[]] if t == s else [[*p, k] for y, k in near[t] if d[y] == d[t] - 1 for p in paths(y)]

        for t in d:
            every = paths(t)
            for k in [k for p in every for k in p]:
                out[k] += 1 / len(every)
    return out


def test_betweenness(nets):
    rows, net = nets
    want = {(f, k): v for f in ("01", "02", "03") for k, v in scored(rows, f).items()}
    for found in (B.edge_betweenness(net, 1000, per_group=7), B.edge_betweenness(net, 1000, per_task=1)):
        got = {(r["fips"], r["edge_id"]): r["betweenness"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_betweenness_of_few_sources_is_scaled(nets):
    net = nets[1].where("fips = '01'")
    a = B.edge_betweenness(net, 12).agg(F.sum("betweenness")).first()[0]
    b = B.levels_betweenness(net, 12).agg(F.sum("betweenness")).first()[0]
    assert abs(a - b) < 1e-6 * a and a > 0


def test_attack_takes_the_most_used_edges(nets, spark):
    rows, net = nets
    sc = D.scenarios(spark, [0.1, 0.5], 1, ("betweenness",), ("edge", "road"))
    gone = D.deletions(net, sc, n_sources=1000).where("fips = '01' and deleted").collect()
    best = sorted(((-round(v, 6), k) for k, v in scored(rows, "01").items()))
    for p in (0.1, 0.5):
        assert sorted(r["edge_id"] for r in gone if r["p"] == p and r["unit"] == "edge") == sorted(k for _, k in best[: round(p * 90)])
        roads = {r["road_key"] for r in gone if r["p"] == p and r["unit"] == "road"}
        assert roads and all(r[6] in roads or r[6] not in roads for r in rows)
        assert {r["edge_id"] for r in gone if r["p"] == p and r["unit"] == "road"} == {r[1] for r in rows if r[0] == "01" and r[6] in roads}
    with pytest.raises(ValueError):
        D.scenarios(spark, [0.1], 1, ("closeness",))


def test_thresholds_give_the_rows_of_a_sort(nets, spark):
    net = nets[1].join(B.edge_betweenness(nets[1], 1000), ["fips", "edge_id"])
    sc = D.scenarios(spark, [0.0, 0.001, 0.13, 0.5, 0.97, 1.0], 2, ("random", "fitness", "betweenness"))
    row = lambda df: sorted(map(tuple, df.where("deleted").select("fips", "protocol", "p", "replicate", "edge_id").collect()))
    a, b = D.delete_edges(net, sc), D.delete_edges(net, sc, most=1)
    assert row(a) == row(b) and row(a)
    assert a.count() == b.count() == 131 * 36 and sorted(a.columns) == sorted(b.columns)


def test_thresholds_of_equal_keys(nets, spark):
    """All keys are equal, so no prefix parts the edges: ids do."""
    net = nets[1].withColumn("betweenness", F.lit(1.0))
    gone = D.delete_edges(net, D.scenarios(spark, [0.2], 1, ("betweenness",)), most=2).where("deleted")
    assert sorted(r["edge_id"] for r in gone.where("fips = '01'").collect()) == list(range(18))


def test_fitness_column_counts(nets, spark):
    net = nets[1].withColumn("fitness", F.when(F.col("edge_id") < 30, 1.0).otherwise(0.0))
    gone = D.deletions(net, D.scenarios(spark, [0.4], 5, ("fitness",))).where("deleted and fips = '01'")
    assert gone.where("edge_id < 30").count() == 0 and gone.count() == 5 * 36


@pytest.mark.parametrize("chunk", [1, 3, 50, 10_000])
def test_contracted_components(spark, chunk):
    rng = random.Random(9)
    rows = [(g, rng.randrange(80), rng.randrange(80)) for g in ("a", None, "c") for _ in range(60)] + [("path", i, i + 1) for i in range(150)] + [("a", None, 3), ("a", 3, None)]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "g string, src long, dst long").repartition(5)
    known = e.where("g is not null")
    want = sorted(map(tuple, keyed_components(known.na.drop(), ["g"]).collect()))
    assert sorted(map(tuple, contracted_components(known, ["g"], chunk).collect())) == want
    one = contracted_components(known.where("g = 'path'").select("src", "dst"), [], chunk)
    assert {r["label"] for r in one.collect()} == {0} and one.count() == 151
    assert contracted_components(known.limit(0), ["g"], chunk).count() == 0


def test_largest_graph_decides(nets, spark):
    net = nets[1]
    small, big = components(net, ["fips"]), components(net, ["fips"], per_task=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
    gone = frozen(D.deletions(net, D.scenarios(spark, [0.3], 2)))
    assert sorted(map(tuple, T.surviving_labels(gone).collect())) == sorted(map(tuple, T.surviving_labels(gone, per_task=5).collect()))


def test_nearest_join(spark):
    rng = random.Random(3)
    points = [(g, i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for g in "ab" for i in range(60)] + [("a", 99, 90_000.0, 4.0), ("z", 1, 0.0, 0.0), ("a", 98, None, 1.0)]
    targets = [(g, j, float(rng.randrange(-500, 500, 40)), float(rng.randrange(-500, 500, 40))) for g in "ab" for j in range(30)]
    got = nearest_join(spark.createDataFrame(points, "g string, id long, x double, y double"), spark.createDataFrame(targets, "g string, target long, x double, y double"), 5.0, ["g"])
    want = []
    for g, i, x, y in points:
        own = [(round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 6), j) for h, j, u, v in targets if h == g] if x is not None else []
        want += [(g, i, min(own)[1], min(own)[0])] if own else []
    assert sorted((r["g"], r["id"], r["target"], round(r["gap"], 5)) for r in got.collect()) == sorted((g, i, j, round(d, 5)) for g, i, j, d in want)
    assert nearest_join(spark.createDataFrame(points, "g string, id long, x double, y double").drop("g"), spark.createDataFrame([], "target long, x double, y double"), 5.0).count() == 0


def test_accessibility(nets, spark):
    rows, net = nets
    gone = frozen(D.deletions(net, D.scenarios(spark, [0.0, 0.35, 1.0], 2)))
    places = spark.createDataFrame([("01", 4), ("01", 4), ("01", 11), ("02", 0)], "fips string, node long")
    got = {(r["fips"], r["p"], r["replicate"]): r for r in A.accessibility(gone, places).collect()}
    far = {(r["fips"], r["p"], r["replicate"]): r for r in A.accessibility(gone, places, per_task=1).collect()}
    alive = {}
    for r in gone.collect():
        key = (r["fips"], r["p"], r["replicate"])
        alive.setdefault(key, []).extend([(r["src"], r["dst"], r["length_m"])] * (not r["deleted"]))
    assert got.keys() == far.keys() == alive.keys()
    for key, edges in alive.items():
        nodes = {n for r in rows if r[0] == key[0] for n in (r[2], r[3])}
        dist, heap = {}, [(0.0, n) for n in {"01": (4, 11), "02": (0,)}.get(key[0], ()) if n in nodes]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in dist:
                dist[n] = d
                for a, b, w in edges:
                    if n in (a, b):
                        heapq.heappush(heap, (d + w, b if n == a else a))
        for r in (got[key], far[key]):
            assert (r["n_nodes"], r["n_unreachable"]) == (len(nodes), len(nodes) - len(dist))
            assert (r["mean_m"] is None) if not dist else abs(r["mean_m"] - sum(dist.values()) / len(dist)) < 1e-9
    curve = {r["p"]: r["unreachable_frac"] for r in A.access_curve(A.accessibility(gone, places)).where("fips = '01'").collect()}
    assert curve[0.0] <= curve[0.35] <= curve[1.0]


def test_snapping(nets, spark):
    rows, net = nets
    ends = {}
    for r in rows:
        ends.setdefault((r[0], r[2]), []).append(r[7:9])
        ends.setdefault((r[0], r[3]), []).append(r[9:11])
    at = {k: (sum(x for x, _ in v) / len(v), sum(y for _, y in v) / len(v)) for k, v in ends.items()}
    got = A.snap(spark.createDataFrame([("01", 1, 400.0, 300.0), ("02", 2, -5000.0, 0.0)], "fips string, id long, x double, y double"), net, 20.0).collect()
    for r in got:
        x, y = (400.0, 300.0) if r["id"] == 1 else (-5000.0, 0.0)
        best = min((round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 6), n) for (f, n), (u, v) in at.items() if f == r["fips"])
        assert (r["node"], round(r["gap"], 4)) == (best[1], round(best[0], 4))
    assert len(got) == 2
