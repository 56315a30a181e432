"""What each filter of a cascade removes under every order of the filters (operator 13).

Each document is reduced to a mask of the filters it fails. Counts of documents by mask and
part are all that orders need: what is kept after a set of filters is the sum of the cells
whose masks avoid the set. The orders of the filters are visited by adjacent transpositions
(plain changes), so from one order to the next only two steps change: the one set of filters
between the swapped two is looked up anew. Shapley counts (a filter's removals summed over all
orders) accumulate along the walk.

Filter E, identical to the text of a smaller id, needs the least id of each text. Texts meet
by SHA-256; rows of one text are counted by part and mask before they are shuffled, so groups
of copies of any size are a few rows of counts.

Defined cases: a null text is empty; a null source is the part of the empty string, and so is
an empty source; a row with a null id is never later than another, nor does it precede one; of
an id's several labels one that says 1 suffices; rows that repeat id and text are documents
each, none smaller than the other; an empty table has no parts and so no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, of a text that is not null."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail exactly the mask's filters. The bit after the filters' is for later copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filters = text_filters(text) if filters is None else filters
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), bits.alias("bits"))
    one = base.groupBy("id", "part", "h", "bits").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flagged = one.join(said, "id", "left").na.fill(0, ["good", "toxic"])
    known = F.col("id").isNotNull()
    same = flagged.groupBy("h", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(known, F.col("id"))).alias("least"), F.min(F.when(known, F.struct("id", "n"))).alias("lead"),
    )
    first = F.min("least").over(W.partitionBy("h"))
    lead = F.col("nameless") + F.when(F.col("least") == first, F.col("lead.n")).otherwise(0)
    split = same.withColumn("lead_n", lead).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("mask"), F.col("lead_n").alias("n")),
        F.struct((F.col("bits") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("lead_n")).alias("n")),
    )).alias("c"))
    n = F.col("c.n")
    return split.where(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Positions i whose swaps with i + 1 lead, one by one, from 0..n-1 through all other orders."""
    at, way = list(range(n)), [-1] * n  # the order, and each number's direction
    while True:
        for k in range(n - 1, -1, -1):  # the largest number that can move over a smaller one
            i = at.index(k)
            j = i + way[k]
            if 0 <= j < n and at[j] < k:
                break
        else:
            return
        at[i], at[j] = at[j], at[i]
        for m in range(k + 1, n):
            way[m] = -way[m]
        yield min(i, j)


def kept_after(cell: np.ndarray) -> np.ndarray:
    """For each set of filters the documents that fail none of it; cell: counts by mask in the last axis."""
    size = cell.shape[-1]
    full = size - 1
    inside = cell.copy()  # sums over subsets of a mask
    bit = 1
    while bit < size:
        has = np.array([s for s in range(size) if s & bit])
        inside[..., has] += inside[..., has ^ bit]
        bit *= 2
    return inside[..., full - np.arange(size)]


def orders(letters: str, counts: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each order of the filters with its removals, [count][step]; counts: [count][mask]."""
    n, kept = len(letters), kept_after(counts)
    order = list(range(n))
    sets = [0]
    for f in order:
        sets.append(sets[-1] | 1 << f)
    gone = np.stack([kept[:, sets[s]] - kept[:, sets[s + 1]] for s in range(n)], 1)
    yield tuple(order), gone.copy()
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        sets[i + 1] = sets[i] | 1 << order[i]
        for s in (i, i + 1):
            gone[:, s] = kept[:, sets[s]] - kept[:, sets[s + 1]]
        yield tuple(order), gone.copy()


def part_rows(letters: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of a part's result, an order's steps after one another; counts: [documents, good, toxic][mask]."""
    n = len(letters)
    walk = list(orders(letters, counts))
    shapley = np.zeros(n, np.int64)
    for order, gone in walk:
        shapley[list(order)] += gone[0]
    at = np.array([o for o, _ in walk])  # [order][step]
    gone = np.stack([g for _, g in walk], 1)  # [count][order][step]
    masks = np.arange(counts.shape[1])
    fails = np.array([counts[0, masks >> f & 1 == 1].sum() for f in range(n)])
    alone = np.array([counts[0, 1 << f] for f in range(n)])
    flat = at.ravel()
    return {
        "filter_order": np.repeat(["".join(letters[f] for f in o) for o, _ in walk], n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(walk)),
        "kept": (counts[0].sum() - gone[0].cumsum(1)).ravel(), "removed": gone[0].ravel(), "redundant": fails[flat] - gone[0].ravel(), "unique_fails": alone[flat],
        "good_lost": gone[1].ravel(), "toxic_lost": gone[2].ravel(), "shapley": shapley[flat],
    }


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", **names) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    filters: failure conditions by letter (``text_filters`` by default); ``copies`` is the letter
    of later copies. All orders are listed, so filters should be few: seven make 5,040."""
    letters = "".join(filters or "ABCD") + copies
    c = cells(docs, labels, filters, **names)
    by_part = c.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a row per mask

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.zeros((3, 1 << len(letters)), np.int64)
                for x in found:
                    counts[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                rows = part_rows(letters, counts)
                yield pa.RecordBatch.from_pydict({"part": [part] * len(rows["step"])} | {k: pa.array(v) for k, v in rows.items()})

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return arrow_map(by_part, each, schema)
