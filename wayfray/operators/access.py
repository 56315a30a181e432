"""Accessibility A(p): how far the nearest facility is along the surviving roads, and for how many nodes there is none.

Distances from all facilities at once: in counties that fit a task by rounds over arrays, one task per county and
scenario; in larger ones by joins, each round relaxing the edges at nodes that came nearer, for all counties and
scenarios at once. Both go on until nothing comes nearer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import frozen, release
from .nearest import nearest_join
from .network import nodes
from .trial import KEYS

#: Edges of a county under a scenario that a task may hold.
PER_TASK = 5_000_000


def snap(facilities: DataFrame, net: DataFrame, cell: float = 500.0) -> DataFrame:
    """fips, id, node, gap: the node nearest to each facility (fips, id, x, y)."""
    return nearest_join(facilities, nodes(net).withColumnRenamed("node", "target"), cell, ["fips"]).withColumnRenamed("target", "node")


def shortest(src: np.ndarray, dst: np.ndarray, length: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and their distance to the nearest start (infinite: none)."""
    ids, ends = np.unique(np.concatenate([src, dst, starts]), return_inverse=True)
    m = len(src)
    u, v, w = np.concatenate([ends[:m], ends[m : 2 * m]]), np.concatenate([ends[m : 2 * m], ends[:m]]), np.tile(length, 2)
    order = np.argsort(u, kind="stable")
    u, v, w = u[order], v[order], w[order]
    first = np.searchsorted(u, np.arange(len(ids) + 1))
    dist = np.full(len(ids), np.inf)
    front = np.unique(ends[2 * m :])
    dist[front] = 0
    while len(front):
        count = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        new = dist[u[at]] + w[at]
        nearer = new < dist[v[at]]
        at, new = at[nearer], new[nearer]
        np.minimum.at(dist, v[at], new)
        front = np.unique(v[at])
    return ids, dist


def distances(deleted: DataFrame, places: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """fips, scenario, node, dist of the nodes that a facility (fips, node) can be reached from along surviving edges."""
    alive = deleted.where(~F.col("deleted")).select(*KEYS, "src", "dst", "length_m")
    starts = places.select("fips", "node").distinct()
    grid = deleted.select(*KEYS).distinct()
    largest = deleted.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
    if largest > per_task:
        return _relaxed(alive, grid.join(starts, "fips"))
    kinds = dict(deleted.dtypes)

    def each(key, edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        node, dist = shortest(edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64), edges["length_m"].to_numpy(float), own["node"].to_numpy(np.int64))
        met = np.isfinite(dist)
        return pd.DataFrame({**dict(zip(KEYS, key, strict=True)), "node": node[met], "dist": dist[met]})[[*KEYS, "node", "dist"]].astype(object)

    asked = grid.join(starts, "fips").select(*(F.col(c).alias(c) for c in (*KEYS, "node")))
    return alive.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInPandas(each, ", ".join(f"{c} {kinds[c]}" for c in KEYS) + f", node {kinds['src']}, dist double")


def _relaxed(alive: DataFrame, starts: DataFrame, tidy: int = 16) -> DataFrame:
    ways = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    steps = frozen(alive.select(*KEYS, "length_m", ways.alias("w")).select(*KEYS, "w.u", "w.v", "length_m"))
    known = frozen(starts.select(*KEYS, "node", F.lit(0.0).alias("dist"), F.lit(True).alias("moved")))
    k = 0
    while not (front := known.where("moved")).isEmpty():
        met = steps.join(front.withColumnRenamed("node", "u"), [*KEYS, "u"]).groupBy(*KEYS, F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("length_m")).alias("new"))
        both = known.join(met, [*KEYS, "node"], "full")
        nearer = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        known = frozen(both.select(*KEYS, "node", F.least("dist", "new").alias("dist"), nearer.alias("moved")))
        k += 1
        if k % tidy == 0:
            release(alive.sparkSession)
    return known.select(*KEYS, "node", "dist")


def accessibility(deleted: DataFrame, places: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """fips, scenario, n_nodes, n_unreachable, unreachable_frac, mean_m (of the nodes that reach a facility; null if none does), max_m.

    deleted: the network under each scenario; places: fips, node of the facilities."""
    every = deleted.select(*KEYS, F.explode(F.array("src", "dst")).alias("node")).distinct()
    far = every.join(distances(deleted, places, per_task), [*KEYS, "node"], "left")
    n, lost = F.count("*"), F.count_if(F.col("dist").isNull())
    return far.groupBy(*KEYS).agg(n.alias("n_nodes"), lost.alias("n_unreachable"), (lost / n).alias("unreachable_frac"), F.avg("dist").alias("mean_m"), F.max("dist").alias("max_m"))


def access_curve(access: DataFrame) -> DataFrame:
    """A(p): the replicates' means at each p."""
    return access.groupBy("fips", "protocol", "unit", "p").agg(F.count("*").alias("n"), F.avg("unreachable_frac").alias("unreachable_frac"), F.avg("mean_m").alias("mean_m"), F.max("max_m").alias("max_m"))
