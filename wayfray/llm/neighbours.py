"""Approximate nearest neighbours by a graph that NN-descent builds and a greedy search of it (operator 11).

Equal vectors are one node; nodes are numbered densely in the order of their hashes.

Graph: each node keeps the ``degree`` nearest nodes found so far. First lists come from leaves
of a few random trees (planes halfway between sampled vectors; leaves of at most ``leaf``
nodes, larger ones are dealt out by hash) and of one tree without planes. Then, round by round, a node's new links and a
bounded share of its old and of its backward links meet: neighbours of neighbours that are
nearer than a member's farthest link become links. New links that had no turn stay new for
a later round. Rounds end when few links are new.

Search: a query starts from its own node's links, if its vector is in the graph, and else from
``entries`` nodes. Each round expands the nearest nodes not yet expanded among the ``beam``
nearest found, joins their links with the vectors, and goes on until all of the beam is
expanded. Distances to what was found are then computed anew in double precision.

Every vector is a node; the sample (``SAMPLE`` rows) only places the trees' planes. Recall is
measured against brute force in the tests and stated in the README.

Defined cases: vectors that are null, empty or zero, or hold a null, NaN or infinite component
take no part; a query meets candidates of its own dimension only; rows that repeat id and
vector are one; rows that share the query's id are not its candidates, and of an id's several
vectors the least of each dimension is the query; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, ranked
from .search import taking_part

#: Rows that place the planes of the trees.
SAMPLE = 2000


def _lists(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column whose rows are equally long, as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(c), -1)


def best(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int, fresh: np.ndarray | None = None) -> np.ndarray:
    """Places of each a's k nearest different b, in order of (a, d, b); of equal pairs a stale one is kept."""
    o = np.lexsort((np.zeros(len(a)) if fresh is None else fresh, b, a))
    o = o[np.r_[True, (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])][: len(o)]]
    o = o[np.lexsort((b[o], d[o], a[o]))]
    start = np.r_[True, a[o][1:] != a[o][:-1]][: len(o)]
    first = np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))
    return o[np.arange(len(o)) - first < k]


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole groups of the sorted column ``key``."""
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(map(len, held)) >= rows:
            t = pa.concat_tables(held)
            keys = t.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield t.slice(0, cut)
            held = [t.slice(cut)]
    if held and sum(map(len, held)):
        yield pa.concat_tables(held)


class _Nearest:
    """Gathers links of one task and lets go of all but each node's k nearest when they are many."""

    def __init__(self, k: int, most: int = 1_000_000):
        self.k, self.most, self.parts, self.n = k, most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        self.parts.append((a, b, d))
        self.n += len(a)
        if self.n > self.most:
            self.squeeze()
            self.most = max(self.most, 2 * self.n)

    def squeeze(self) -> None:
        a, b, d = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keep = best(a, b, d, self.k)
        self.parts, self.n = [(a[keep], b[keep], d[keep])], len(keep)

    def batches(self, names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.squeeze()
            for i in range(0, self.n, rows):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + rows]) for x in self.parts[0]], names)


def numbered(vectors: DataFrame, tables: Scratch) -> DataFrame:
    """node, d, v (double), f (float, scaled by a power of two so that squares neither overflow nor vanish): the different vectors."""
    one = vectors.groupBy("d", "v").agg(F.lit(1).alias("_one")).drop("_one")
    top = one.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scale = 2.0 ** -int(np.frexp(top or 1.0)[1])
    return tables.keep(ranked(one, [F.xxhash64("v"), F.col("d"), F.col("v")], "node").select("node", "d", "v", F.transform("v", lambda x: (x * scale).cast("float")).alias("f")))


def _planes(nodes: DataFrame, leaf: int, trees: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension of the sample the planes (tree by depth) of its trees and their offsets; at most 64 planes a tree."""
    few = nodes.orderBy("node").limit(SAMPLE).select("d", "f").collect()  # nodes are in order of hashes
    counts = {r["d"]: r["count"] for r in nodes.groupBy("d").count().where(F.col("count") > leaf).join(F.broadcast(nodes.where(F.col("node") < SAMPLE).select("d").distinct()), "d").collect()}  # dimensions of the sample
    out = {}
    for d, n in counts.items():
        x = np.array([r["f"] for r in few if r["d"] == d])
        depth = min(int(np.ceil(np.log2(n / leaf))) + 1, 62)
        rng = np.random.default_rng(d)
        p, q = x[rng.integers(0, len(x), (trees, depth))], x[rng.integers(0, len(x), (trees, depth))]
        out[d] = (p - q, ((p**2).sum(2) - (q**2).sum(2)) / 2)
    return out


def first_links(nodes: DataFrame, degree: int, leaf: int, trees: int) -> DataFrame:
    """a, b, dist: the nearest that share a leaf."""
    known = nodes.sparkSession.sparkContext.broadcast(_planes(nodes, leaf, trees))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("d").to_numpy()
            code = np.zeros((len(dims), trees), np.int64)
            for d in np.unique(dims).tolist():
                if d in known.value:
                    at = np.flatnonzero(dims == d)
                    planes, offsets = known.value[d]
                    x = _lists(b.column("f").take(pa.array(at)))
                    side = np.einsum("nd,tpd->ntp", x, planes) > offsets
                    code[at] = side @ (1 << np.arange(side.shape[2], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("d"), b.column("f"), pa.array(code.tolist(), pa.list_(pa.int64()))], ["node", "d", "f", "codes"])

    placed = arrow_map(nodes.select("node", "d", "f"), codes, "node long, d int, f array<float>, codes array<long>", 4096)
    with_one = F.concat("codes", F.array(F.lit(0).cast("long")))  # one more tree has no planes: every node has links, far ones too
    placed = placed.select("node", "d", "f", F.posexplode(with_one).alias("tree", "code"))
    size = placed.groupBy("d", "tree", "code").agg(F.ceil(F.count("*") / leaf).alias("n"))
    chunk = F.pmod(F.col("node"), F.col("n"))  # nodes are numbered in order of hashes
    leaves = placed.join(size, ["d", "tree", "code"]).select("node", "f", F.xxhash64("d", "tree", "code", chunk).alias("leaf"), "d")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Nearest(degree)
        for t in _runs(batches, "leaf", 4 * leaf):
            keys, dims = t.column("leaf").to_numpy(), t.column("d").to_numpy()
            for own in np.split(np.arange(len(keys)), np.flatnonzero((keys[1:] != keys[:-1]) | (dims[1:] != dims[:-1])) + 1):
                x, ids = _lists(t.column("f").take(pa.array(own))), t.column("node").to_numpy()[own]
                for s in range(0, len(ids), leaf):  # the rows of a leaf in strips; two leaves of one hash only make a strip longer
                    dist = _distances(x[s : s + leaf], x)
                    dist[np.arange(len(dist)), s + np.arange(len(dist))] = np.inf
                    k = min(degree, len(ids) - 1)
                    if k > 0:
                        at = np.argpartition(dist, k - 1, 1)[:, :k]
                        near.add(np.repeat(ids[s : s + leaf], k), ids[at].ravel(), np.take_along_axis(dist, at, 1).ravel().astype(np.float32))
        yield from near.batches(["a", "b", "dist"])

    return arrow_map(leaves.repartition("leaf").sortWithinPartitions("leaf", "d"), links, "a long, b long, dist float", 1024)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def _merged(found: DataFrame, degree: int, turn: int, seed: int) -> DataFrame:
    """a, b, dist, fresh, turn: each node's nearest links of (a, b, dist, fresh); ``turn`` marks up to ``turn`` fresh and as many other links that meet in the next round."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "a", 200_000):
            a, b, d, fresh = (t.column(c).to_numpy() for c in ("a", "b", "dist", "fresh"))
            keep = best(a, b, d, degree, fresh)
            a, b, d, fresh = a[keep], b[keep], d[keep], fresh[keep]
            lot = (a * 0x9E3779B1 + b * 0x85EBCA77 + seed * 0xC2B2AE3D) * 0x27D4EB2F >> 7 & 0xFFFFFFFF
            o = np.lexsort((lot, fresh, a))
            start = np.r_[True, (a[o][1:] != a[o][:-1]) | (fresh[o][1:] != fresh[o][:-1])][: len(o)]
            place = np.empty(len(o), np.int64)
            place[o] = np.arange(len(o)) - np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, d, fresh, place < turn)], ["a", "b", "dist", "fresh", "turn"])

    return arrow_map(found.repartition("a").sortWithinPartitions("a"), each, "a long, b long, dist float, fresh int, turn boolean", 20_000)


def _local_join(degree: int, names: list[str]) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Nearest(degree)
        for t in _runs(batches, "list", 20_000):
            keys, m, fresh, far = (t.column(c).to_numpy() for c in ("list", "m", "fresh", "far"))
            x = _lists(t.column("f")) if len(set(pc.list_value_length(t.column("f")).to_pylist())) == 1 else None
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for own in np.split(np.arange(len(keys)), cuts):
                _, once = np.unique(m[own] * 2 + (1 - fresh[own]), return_index=True)
                own = own[once]
                own = own[np.r_[True, m[own][1:] != m[own][:-1]]]  # fresh before stale
                if len(own) < 2 or not fresh[own].any():
                    continue
                y = x[own] if x is not None else _lists(t.column("f").take(pa.array(own)))
                d = _distances(y, y).astype(np.float32)
                f = fresh[own] == 1
                d[~(f[:, None] | f[None])] = np.inf
                np.fill_diagonal(d, np.inf)
                i, j = np.nonzero(d < far[own][:, None])
                if len(i):
                    near.add(m[own][i], m[own][j], d[i, j])
        yield from near.batches(names)

    return each


def neighbour_graph(nodes: DataFrame, tables: Scratch, degree: int = 32, turn: int = 12, leaf: int = 512, trees: int = 4, rounds: int = 12, few: float = 0.05) -> DataFrame:
    """a, b, dist (squared, of f): links of nodes (node, d, f), up to ``degree`` a node."""
    found = first_links(nodes, degree, leaf, trees).withColumn("fresh", F.lit(1))
    graph = tables.keep(_merged(found, degree, turn, 0))
    for k in range(1, rounds + 1):
        share = graph.agg(F.avg("fresh")).first()[0]
        if not share or share < few:
            break
        ends = graph.groupBy("a").agg(F.when(F.count("*") >= degree, F.max("dist")).otherwise(float("inf")).cast("float").alias("far"))
        about = nodes.select("node", "f").join(ends.withColumnRenamed("a", "node"), "node", "left").na.fill(float("inf"), ["far"]).withColumnRenamed("node", "m")
        meet = graph.where("turn").select("a", "b", "fresh")
        back = meet.select(F.col("b").alias("list"), F.col("a").alias("m"), "fresh")
        lot = F.row_number().over(W.partitionBy("list", "fresh").orderBy(F.xxhash64("m", F.lit(k)), "m"))
        back = back.withColumn("_r", lot).where(F.col("_r") <= turn).drop("_r")
        members = meet.select(F.col("a").alias("list"), F.col("b").alias("m"), "fresh").unionByName(back)
        with_vectors = members.join(about, "m").select("list", "m", "fresh", "far", "f")
        better = arrow_map(with_vectors.repartition("list").sortWithinPartitions("list"), _local_join(degree, ["a", "b", "dist"]), "a long, b long, dist float", 4096)
        stale = graph.select("a", "b", "dist", F.when(F.col("turn"), 0).otherwise(F.col("fresh")).alias("fresh"))
        old, graph = graph, tables.keep(_merged(stale.unionByName(better.withColumn("fresh", F.lit(1))), degree, turn, k))
        tables.drop(old)
    return graph.select("a", "b", "dist")


def _beam(size: int, step: int) -> Callable:
    """Each query's nearest nodes; ``todo`` marks those to expand next."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "q", 50_000):
            q, node, d, done = (t.column(c).to_numpy() for c in ("q", "node", "dist", "done"))
            keep = best(q, node, d, size, -done)
            q, node, d, done = q[keep], node[keep], d[keep], done[keep]
            open_ = done == 0
            upto = np.cumsum(open_)
            start = np.r_[True, q[1:] != q[:-1]]
            before = np.maximum.accumulate(np.where(start, upto - open_, 0))
            todo = open_ & (upto - before <= step)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, node, d, done, todo)], ["q", "node", "dist", "done", "todo"])

    return each


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared distances of f and g."""
    for b in batches:
        same = len(b) and len(set(pc.list_value_length(b.column("f")).to_pylist())) == 1
        if same:
            d = ((_lists(b.column("f")) - _lists(b.column("g"))) ** 2).sum(1)
        else:
            d = np.array([((np.array(x) - np.array(y)) ** 2).sum() for x, y in zip(b.column("f").to_pylist(), b.column("g").to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(d, pa.float64())], ["q", "node", "dist"])


def greedy_search(asked: DataFrame, nodes: DataFrame, graph: DataFrame, tables: Scratch, beam: int = 256, step: int | None = None, entries: int = 32, rounds: int = 100) -> DataFrame:
    """q, node, dist: up to ``beam`` nearest nodes found for each query (q, d, f; q is its own node's number where it has one).

    A round expands up to ``step`` nodes of a query, by default all of its beam that aren't expanded yet."""
    last = nodes.agg(F.max("node")).first()[0]
    every = max(1, -(-((last or 0) + 1) // entries))
    doors = nodes.where(F.col("node") % every == 0).select("node", "d", F.col("f").alias("g"))  # at most ``entries`` rows
    own = asked.join(graph.select(F.col("a").alias("q"), F.col("b").alias("node")), "q").join(nodes.select("node", F.col("f").alias("g")), "node").select("q", "node", "f", "g")
    outside = asked.join(graph.select(F.col("a").alias("q")).distinct(), "q", "left_anti")
    pairs = own.unionByName(outside.join(F.broadcast(doors), "d").select("q", "node", "f", "g")).dropDuplicates(["q", "node"])
    schema = "q long, node long, dist double"
    first = tables.keep(arrow_map(pairs, _measured, schema, 4096))
    seen, state, now = [first.select("q", "node")], first.withColumn("done", F.lit(0)), None
    step_schema = "q long, node long, dist double, done int, todo boolean"
    for k in range(rounds + 1):
        old, now = now, tables.keep(arrow_map(state.repartition("q").sortWithinPartitions("q"), _beam(beam, step or beam), step_schema, 20_000))
        if old is not None:
            tables.drop(old)
        todo = now.where("todo")
        if k == rounds or todo.isEmpty():
            break
        far = now.groupBy("q").agg(F.when(F.count("*") >= beam, F.max("dist")).otherwise(float("inf")).alias("far"))
        met = reduce(DataFrame.unionByName, seen)
        fresh = todo.join(graph, F.col("node") == F.col("a")).select("q", F.col("b").alias("node")).distinct().join(met, ["q", "node"], "left_anti")
        bound = asked.select("q", "f").join(far, "q")
        both = fresh.join(bound, "q").join(nodes.select("node", F.col("f").alias("g")), "node")
        found = tables.keep(arrow_map(both.select("q", "node", "f", "g"), _measured, schema, 4096))
        seen.append(found.select("q", "node"))
        state = now.select("q", "node", "dist", F.when(F.col("todo"), 1).otherwise(F.col("done")).alias("done")).unionByName(found.join(far, "q").where("dist < far").select("q", "node", "dist", F.lit(0).alias("done")))
    return now.select("q", "node", "dist")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, degree: int = 32, beam: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **graph_options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found. is_query: a condition on ``id``."""
    tables = Scratch(vectors.sparkSession)
    part = taking_part(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0)).select("id", "v", "d").distinct()
    base = tables.keep(part)
    nodes = numbered(base.select("d", "v"), tables)
    graph = neighbour_graph(nodes, tables, degree, **graph_options)
    queries = tables.keep(base.where(is_query).groupBy("id", "d").agg(F.min("v").alias("v")).join(nodes, ["d", "v"]).select("id", "node", "d", "v", "f"))
    asked = queries.select(F.col("node").alias("q"), "d", "f").dropDuplicates(["q"])  # equal queries are searched once
    found = greedy_search(asked, nodes, graph, tables, max(beam, 2 * k)).unionByName(asked.select("q", F.col("q").alias("node"), F.lit(0.0).alias("dist")))
    place = F.row_number().over(W.partitionBy("q").orderBy("dist", "node"))
    close = found.dropDuplicates(["q", "node"]).withColumn("_r", place).where(F.col("_r") <= 4 * k + 1).select("q", "node")
    exact = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    with_scores = close.join(nodes.select(F.col("node").alias("q"), "v"), "q").join(nodes.select("node", F.col("v").alias("w")), "node").select("q", "node", exact.alias("score"))
    # the k + 1 least ids of a node: one of them may be the query itself
    ids = base.withColumn("_r", F.row_number().over(W.partitionBy("d", "v").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    ids = ids.join(nodes.select("node", "d", "v"), ["d", "v"]).select("node", F.col("id").alias("vec_id"))
    some = with_scores.join(ids, "node").withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    salt = 16  # many queries may have one vector
    spread = queries.select(F.col("id").alias("query_id"), F.col("node").alias("q"), F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(salt)).cast("int").alias("_s"))
    answers = spread.join(some.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), ["q", "_s"]).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
