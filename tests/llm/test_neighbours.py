"""Approximate neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfray.llm import neighbours
from wayfray.llm.neighbours import best

SCHEMA = "vec_id long, embedding array<double>, node long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    part = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in {i for i, _ in part if i % every == 0}:
        for d in {len(v) for j, v in part if j == i}:
            q = min(v for j, v in part if j == i and len(v) == d)
            out.setdefault(i, []).extend((float(np.sqrt(((np.array(v) - q) ** 2).sum())), j) for j, v in part if j != i and len(v) == d)
    return {i: sorted(x)[:k] for i, x in out.items() if x}


def hits(got, want):
    """Share of the wanted places whose distance was reached."""
    own = {}
    for r in got:
        own.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q, x in own.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, len(x) + 1)) and [(s, v) for _, v, s in x] == sorted((s, v) for _, v, s in x)
        found += sum(s <= want[q][-1][0] + 1e-9 for _, _, s in x)
    return found / sum(map(len, want.values()))


def test_best():
    a, b = np.array([1, 1, 1, 0, 1, 0]), np.array([5, 6, 5, 9, 7, 9])
    d, fresh = np.array([0.3, 0.1, 0.3, 0.5, 0.2, 0.5]), np.array([1, 1, 0, 0, 1, 1])
    keep = best(a, b, d, 2, fresh)
    assert [(a[i], b[i], fresh[i]) for i in keep] == [(0, 9, 0), (1, 6, 1), (1, 7, 1)]
    assert len(best(a[:0], b[:0], d[:0], 3)) == 0


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(60, None), (61, []), (62, [0.0] * 6), (63, [1.0, None, 1, 1, 1, 1]), (64, [float("nan")] * 6), (65, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(i, [1.0, 2, 3, 4, 5, 6]) for i in range(70, 110)] + [(80, [1.0, 2, 3, 4, 5, 6])] * 2  # more copies than answers
    rows += [(i, [float(i), 1.0]) for i in range(110, 125)] + [(10, [2.0, 2.0]), (10, [1.0, 3.0]), (20, [3.0] * 3), (7, rows[8][1])]
    got = neighbours.nearest(frame(spark, rows), F.col("id") % 10 == 0, k=4).collect()
    want = brute(rows, 4, 10)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted((i, r, j, round(s, 9)) for i, x in want.items() for r, (s, j) in enumerate(x, 1))


def test_nothing(spark):
    assert neighbours.nearest(frame(spark, [(1, [1.0])]).limit(0), F.col("id") % 10 == 0).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [1.0])]), F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("kind", ["spread", "clusters", "offset"])
def test_recall(spark, kind):
    """The graph's rounds and the search, at sizes where leaves hold a small part of the rows."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = x * 0.05 + rng.normal(size=(12, 16))[rng.integers(0, 12, 3000) * (rng.random(3000) > 0.4)]
    if kind == "offset":
        x = (x + 3000).round(3)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = neighbours.nearest(frame(spark, rows), F.col("id") % 50 == 0, degree=12, beam=48, leaf=48, trees=2, turn=8).collect()
    assert hits(got, brute(rows, 10, 50)) >= 0.9


def test_rounds_better_the_first_links(spark):
    from wayfray.llm.common import Scratch
    from wayfray.llm.neighbours import neighbour_graph, numbered

    rng = np.random.default_rng(2)
    tables = Scratch(spark)
    nodes = numbered(spark.createDataFrame([(12, v) for v in rng.normal(size=(1500, 12)).tolist()], "d int, v array<double>"), tables)
    x = np.array([r["f"] for r in nodes.orderBy("node").collect()])
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), 1)[:, 1:11]

    def recall(rounds):
        links = {}
        for r in neighbour_graph(nodes, tables, 10, 6, 32, 1, rounds).collect():
            links.setdefault(r["a"], set()).add(r["b"])
        assert max(map(len, links.values())) <= 10
        return np.mean([len(links[i] & set(near[i].tolist())) / 10 for i in range(len(x))])

    assert recall(0) < 0.5 < 0.8 < recall(8)
