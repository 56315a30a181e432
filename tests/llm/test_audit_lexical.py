"""The filter audit and the ranked search against brute force, on fixtures with nulls, ties, repeated rows and clashing columns."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from test_operators import frame

from wayfray.llm import audit, lexical
from wayfray.llm.audit import kept_after, orders, plain_changes


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_plain_changes_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_orders_against_a_cascade():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, (2, 32))
    masks = np.arange(32)
    for order, gone in orders("ABCDE", counts):
        left = counts.copy()
        for s, f in enumerate(order):
            out = np.where(masks >> f & 1 == 1, left, 0)
            assert (gone[:, s] == out.sum(1)).all()
            left = left - out
    assert (kept_after(counts)[:, 0] == counts.sum(1)).all()


def brute_audit(rows, labels):
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((s or "", {k for k, v in fails.items() if v}, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(o, 1):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = [d for d in own if f in d[1]]
                out[part, "".join(o), step] = [len(stay), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
                left = stay
        for k in [k for k in out if k[0] == part]:
            out[k].append(shapley[k[1][k[2] - 1]])
    return out


def odd_rows():
    rng = random.Random(11)
    words = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    base = words(220, 400)
    rows = [(0, None, "a"), (1, "", None), (2, "  \n", ""), (3, base, "a"), (4, base, "a"), (4, base, "b"), (5, base, "a"), (None, base, "a"), (None, None, "c"), (6, base.upper(), "a"), (7, base + " #", "b"), (7, base + " #", "b")]
    rows += [(i, words(rng.randrange(150, 400), rng.choice([20, 900])) + rng.choice(["", " $", " ABCDEFGHIJ KLMNOPQ"]), rng.choice(["a", "b", None, "é"])) for i in range(8, 60)]
    return [*rows, (60, rows[20][1], "b"), (61, words(30_000, 40_000), "a")]


def test_audit(spark):
    rows = odd_rows()
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 50, 2)] + [(3, 0, 1), (4, None, None), (4, 1, 0), (4, 0, 0), (None, 1, 1)]
    got = audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): [*r][3:] for r in got} == want and len(got) == len(want)


def test_audit_of_other_filters_and_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = frame(spark, odd_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = audit.audit(docs, labels, {"X": F.coalesce(F.col("doc_id") > 9, F.lit(False))}, copies="Y")
    assert {r["filter_order"] for r in few.collect()} == {"XY", "YX"}
    assert audit.audit(docs.limit(0), labels).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k):
    fold = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, fold(t)) for i, t, _ in rows]
    n_docs, n_words = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in docs:
            m = 25 + 75 * len(w) * n_docs // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in fold(text) if x in df and x in w)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


@pytest.mark.parametrize("shard_docs", [7, 4096])
def test_ranked_search(spark, shard_docs):
    rng = random.Random(4)
    words = lambda n, v=60: " ".join(rng.choice([f"W{rng.randrange(v)}", f"é{rng.randrange(v)}", f"x-y{rng.randrange(v)}"]) for _ in range(n))
    rows = [(0, None, "a"), (1, "", "a"), (2, "!!", "a"), (3, "rare", "a"), (3, "rare", "a"), (None, "rare word", "a"), (4, words(9000), "a")]
    rows += [(i, words(rng.randrange(1, 60)), "a") for i in range(5, 90)] + [(i, "the same text of them all", "a") for i in range(90, 130)] + [(90, "the same text of them all", "a")] * 3
    items = [(0, "rare"), (1, "the same TEXT text"), (2, words(25)), (3, None), (4, "unheard-of"), (5, "w1 É1 é1 w1 w1"), (None, "w2 w3"), (6, words(40)), (7, "x")]
    got = lexical.ranked_search(frame(spark, rows), spark.createDataFrame([(i, t, "t", 0.5, 1) for i, t in items], "item_id long, text string, term string, score double, row int"), shard_docs=shard_docs, block=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_search(rows, items, 10), key=str)


def test_ranked_search_of_nothing(spark):
    docs, items = frame(spark, [(1, "a b", "s")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0
