"""Ranked lexical search by three-phase uniform thresholds over term-partitioned postings (operator 12).

Postings are kept in blocks of a term and a shard (up to ``SHARD`` documents of a task); a
term of any frequency is as many blocks as there are shards. Only terms of some item are
listed: a bit map of fixed size lets candidates through, and an exact join on the term follows.

1. Each list's head, its ``k`` largest entries, gives partial scores; an item's k-th largest
   is a lower bound of its k-th score.
2. Every list of an item is cut at the same weighted value, the bound over the number of its
   lists: a document that stands in no cut list scores less than the bound. Cut lists meet by
   shard. Partial scores give a higher bound; documents that can still reach it, with the most
   that what was cut off can add, are candidates.
3. The candidates' entries are looked up in the whole lists, which makes their scores exact.

Items are worked off in blocks of ``ITEMS``, so that a task's part of the queries is bounded.
All scores are integers. The bounds hold for ties too: a document whose score may equal the
k-th stays a candidate.

Defined cases: a null text has no terms; documents that repeat an id are documents each, of
equal rank by id; an item without a known term has no rows; of several texts of one item id
the least counts, null ids are an item; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_map, binary, bit_map, in_map, null_safe

#: Documents of a shard, items of a block.
SHARD, ITEMS = 4096, 256
#: Bits of the map of the items' terms, and of the map of candidates.
MAP_BITS = 1 << 24
#: A byte stays, in lower case, if it belongs to a term, and else becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The fixed figures of the score: floor(SCALE * tf / (TF * tf + LENGTH * m)), m = BASE + LONG * n * N div L.
SCALE, TF, LENGTH, BASE, LONG = 1_000_000_000, 1000, 8, 25, 75


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def item_terms(names: DataFrame) -> DataFrame:
    """g, term, h (the term's hash), q: the terms of each item (g, text) and how often they occur."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [Counter(terms(t)) for t in binary(b, "text")]
            at, words = np.repeat(np.arange(len(found)), [len(c) for c in found]), [w for c in found for w in c]
            count = pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("g").take(pa.array(at)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(hashes.of(words).view(np.int64)), count], ["g", "term", "h", "q"])

    return arrow_map(names.select("g", "text"), each, "g string, term string, h long, q long")


def postings(docs: DataFrame, wanted: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD) -> DataFrame:
    """Rows of documents (term null: row, doc, n) and of blocks (term, shard, and packed 32-bit ats, tfs, ns).

    A shard is named by its first row; rows of a task are numbered on end, so shard + at is the row."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = dict(base.dtypes)["doc"]
    known = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["term", "shard", "row", "doc", "n", "ats", "tfs", "ns"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, let = WordHashes(), {}
        lists: dict[bytes, tuple[list, list, list]] = {}
        shard, used = None, 0

        def let_through(words: list[bytes]) -> None:
            fresh = [w for w in words if w not in let]
            if fresh:
                if len(let) > hashes.most:
                    let.clear()
                    fresh = words
                let.update(zip(fresh, in_map(known.value, hashes.of(fresh)).tolist(), strict=True))

        def blocks() -> pa.RecordBatch:
            packed = lambda i: pa.array([np.array(x[i], "<i4").tobytes() for x in lists.values()], pa.binary())
            n = len(lists)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(lists), pa.binary()).cast(pa.string()), pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, doc_type), pa.nulls(n, pa.int64()), packed(0), packed(1), packed(2)], names
            )

        for b in batches:
            doc_type = b.schema.field("doc").type
            rows, texts = b.column("row").to_pylist(), binary(b, "text")
            sizes = []
            for row, text in zip(rows, texts, strict=True):
                if shard is None or used == shard_docs:
                    if lists:
                        yield blocks()
                    lists, shard, used = {}, row, 0
                found = terms(text)
                n, count = len(found), Counter(found)
                let_through(list(count))
                for w, tf in count.items():
                    if let[w]:
                        x = lists.get(w)
                        if x is None:
                            x = lists[w] = ([], [], [])
                        x[0].append(used)
                        x[1].append(tf)
                        x[2].append(n)
                sizes.append(n)
                used += 1
            k = len(rows)
            empty = pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), b.column("row"), b.column("doc"), pa.array(sizes, pa.int64()), empty, empty, empty], names)
        if lists:
            yield blocks()

    return arrow_map(base, each, f"term string, shard long, row long, doc {kind}, n long, ats binary, tfs binary, ns binary")


def _impacts(tfs: bytes, ns: bytes, docs: int, words: int) -> np.ndarray:
    tf, n = np.frombuffer(tfs, "<i4").astype(np.int64), np.frombuffer(ns, "<i4").astype(np.int64)
    return SCALE * tf // (TF * tf + LENGTH * (BASE + LONG * n * docs // words))


def _entries(lists: DataFrame, docs: int, words: int, choose) -> DataFrame:
    """term, row, impact of single entries of blocks. choose(block, ats, impacts) gives the places to keep."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, impacts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, r in enumerate(b.to_pylist()):
                a, v = np.frombuffer(r["ats"], "<i4"), _impacts(r["tfs"], r["ns"], docs, words)
                keep = choose(r, a, v)
                at.append(np.full(len(keep), i))
                rows.append(r["shard"] + a[keep].astype(np.int64))
                impacts.append(v[keep])
            yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(rows)), pa.array(np.concatenate(impacts))], ["term", "row", "impact"])

    return arrow_map(lists, each, "term string, row long, impact long")


def kth(scores: DataFrame, k: int, value: str, name: str) -> DataFrame:
    """g, name: the k-th largest value of each item, 0 where there are fewer."""
    place = F.row_number().over(W.partitionBy("g").orderBy(F.col(value).desc()))
    top = scores.select("g", value).withColumn("_r", place).where(F.col("_r") <= k)
    return top.groupBy("g").agg(F.max(F.when(F.col("_r") == k, F.col(value)).otherwise(0)).alias(name))


def _cut(lists: DataFrame, docs: int, words: int) -> DataFrame:
    """Blocks (group, term, shard, ats, impacts packed) of the entries of at least ``need``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, ats, imps = [], [], []
            for i, r in enumerate(b.to_pylist()):
                a, v = np.frombuffer(r["ats"], "<i4"), _impacts(r["tfs"], r["ns"], docs, words)
                keep = v >= r["need"]
                if keep.any():
                    places.append(i)
                    ats.append(a[keep].tobytes())
                    imps.append(v[keep].astype("<i4").tobytes())
            t = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(t) for c in ("group", "term", "shard")), pa.array(ats, pa.binary()), pa.array(imps, pa.binary())], ["group", "term", "shard", "ats", "impacts"])

    return arrow_map(lists, each, "group int, term string, shard long, ats binary, impacts binary")


def _meet(k: int, shard_docs: int, choose: bool):
    """For each item and shard the k largest partial scores, or with ``choose`` the documents whose score may reach the item's bound."""

    def each(key, cut: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        lists = {t: (np.frombuffer(a, "<i4"), np.frombuffer(v, "<i4").astype(np.int64)) for t, a, v in zip(cut["term"], cut["ats"], cut["impacts"], strict=True)}
        out = []
        for g, low, of_terms, qws, needs in zip(items["g"], items["low"], items["terms"], items["qws"], items["needs"], strict=True):
            partial, seen, rest = np.zeros(shard_docs, np.int64), np.zeros(shard_docs, np.int64), 0
            for t, qw, need in zip(of_terms, qws, needs, strict=True):
                x, cap = lists.get(t), int(qw) * (int(need) - 1)  # an entry that was cut off adds no more
                rest += cap
                if x is not None:
                    partial[x[0]] += int(qw) * x[1]
                    if choose:
                        seen[x[0]] += cap
            at = np.flatnonzero(partial)
            if choose:
                at = at[partial[at] + rest - seen[at] >= low]
            elif len(at) > k:
                at = at[np.argpartition(-partial[at], k - 1)[:k]]
            out.append(pd.DataFrame({"g": g, "row": int(key[1]) + at, "partial": partial[at]}))
        return pd.concat(out) if out else pd.DataFrame({"g": [], "row": [], "partial": []})

    return each


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_docs: int = SHARD, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    tables = Scratch(spark)
    names = items.select(null_safe(item_col).alias("g"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).groupBy("g", "item_id").agg(F.min("text").alias("text"))
    asked = tables.keep(item_terms(names))
    wanted = bit_map(asked.select("h").distinct(), "h", MAP_BITS)
    raw = postings(docs, wanted, id_col, text_col, shard_docs)
    spread = F.when(F.col("term").isNull(), F.hash("row")).otherwise(F.hash("term", F.hash("shard") % 64))  # a list goes to 64 places
    index = tables.keep(raw.repartition(spread).sortWithinPartitions("term"))
    papers = index.where("term is null").select("row", "doc", "n")
    lists = index.where("term is not null").select("term", "shard", "ats", "tfs", "ns")
    n_docs, n_words = papers.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    n_words = n_words or 1

    held = lists.groupBy("term").agg(F.sum(F.length("ats") / 4).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    q = asked.join(held, "term").select("g", "term", (F.col("q") * weight).cast("long").alias("qw")).where("qw > 0")
    groups = max(1, -(-asked.select("g").distinct().count() // block))
    q = q.join(q.groupBy("g").agg(F.count("*").alias("lists")), "g").withColumn("group", F.pmod(F.xxhash64("g"), F.lit(groups)).cast("int"))
    q = tables.keep(q)

    # 1: the heads of the lists
    largest = lambda r, a, v: np.argpartition(-v, k - 1)[:k] if len(v) > k else np.arange(len(v))
    heads = _entries(lists, n_docs, n_words, largest)
    heads = heads.withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy(F.col("impact").desc(), "row"))).where(F.col("_r") <= k)
    partial = heads.join(q, "term").groupBy("g", "row").agg(F.sum(F.col("qw") * F.col("impact")).alias("partial"))
    q = tables.keep(q.join(kth(partial, k, "partial", "low"), "g", "left").na.fill(0, ["low"]))

    # 2: every list of an item is cut at the same weighted value; a group's lists at what the least demanding of its items needs
    need = F.greatest(F.lit(1), F.expr("(low + lists * qw - 1) div (lists * qw)"))
    needs = q.groupBy("group", "term").agg(F.min(need).alias("need"))
    parts = max(1, -(-n_docs // (64 * shard_docs)))  # a hot list, and the shards of a group, are dealt to so many places
    spot, spots = F.pmod(F.hash("shard"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cut = tables.keep(_cut(lists.withColumn("spot", spot).join(needs.withColumn("spot", spots), ["term", "spot"]).select("group", "term", "shard", "ats", "tfs", "ns", "need"), n_docs, n_words))
    of = F.collect_list(F.struct("term", "qw", "need"))  # the terms of one item
    packed = q.join(needs, ["group", "term"]).groupBy("group", "g", "low").agg(of.alias("of")).select("group", "g", "low", F.col("of.term").alias("terms"), F.col("of.qw").alias("qws"), F.col("of.need").alias("needs"))
    shards = cut.select("group", "shard").distinct().withColumn("spot", spot)

    def met(bounds: DataFrame, choose: bool) -> DataFrame:
        per_shard = shards.join(bounds.withColumn("spot", spots), ["group", "spot"])
        per_shard = per_shard.select(*(F.col(c).alias(c) for c in ("group", "shard", "g", "low", "terms", "qws", "needs")))  # names of its own beside cut's
        return cut.groupBy("group", "shard").cogroup(per_shard.groupBy("group", "shard")).applyInPandas(_meet(k, shard_docs, choose), "g string, row long, partial long")

    second = kth(met(packed, False), k, "partial", "second")
    packed = packed.join(second, "g", "left").withColumn("low", F.greatest("low", F.coalesce("second", F.lit(0)), F.lit(1))).drop("second")
    alive = tables.keep(met(packed, True).select("g", "row"))

    # 3: the candidates' scores, from the whole lists
    sought = spark.sparkContext.broadcast(bit_map(alive.select("row").distinct(), "row", MAP_BITS))
    found = _entries(lists, n_docs, n_words, lambda r, a, v: np.flatnonzero(in_map(sought.value, (r["shard"] + a.astype(np.int64)).view(np.uint64))))
    exact = alive.join(q.select("g", "term", "qw"), "g").join(found, ["term", "row"]).groupBy("g", "row").agg(F.sum(F.col("qw") * F.col("impact")).alias("score")).where("score > 0")
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "row"))
    best = exact.join(papers, "row").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(names.select("g", "item_id"), "g").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
