"""Substring dedup over a compacted De Bruijn graph (operator 2).

Every run of ``window`` words is an edge between the runs of one word less at its ends.
Consecutive edges that share their minimiser (the least hashed ``k``-word run inside) are a
path. Paths of equal minimiser meet in a Spark aggregate: one document - nothing repeats;
several documents, all with the same path - a repeated path without branches, compact: the
whole of it belongs to the smallest document; different paths - the path branches and is
taken apart into its edges, which meet in a second aggregate. Owners join back to their
documents, whose words' coordinates are marked and cut.

Paths that may repeat are found again through a bit map of fixed size (``filter_bits``);
when it fills up, more rows reach the exact join that follows, and nothing else changes.

Defined cases: null, empty and short texts lose nothing; a row with a null doc_id neither
owns nor loses words; repeated rows are judged alike, as a document does not repeat itself;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, binary, bit_map, frozen, gram_hashes, in_map

_M = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M
    return h ^ (h >> _S)


def paths(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """edges, starts, minimisers, contents: the hash of each edge; for each path its first edge, minimiser and content hash."""
    edges = gram_hashes(words, window)
    none = np.zeros(0, np.uint64)
    if not len(edges):
        return edges, np.zeros(0, np.int64), none, none
    low = _mix(gram_hashes(words, k))
    span, left = 1, window - k + 1
    while span < left:  # least of each `left` consecutive, by doubling
        step = min(span, left - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place = np.arange(len(edges), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(edges)))).astype(np.uint64)
    contents = np.add.reduceat(_mix(edges + place * _M), starts)
    return edges, starts, low[starts], contents


def _path_rows(window: int, k: int):
    def each(batches):
        words = WordHashes()
        for b in batches:
            ids, m, c = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), binary(b, "text"), strict=True):
                _, _, low, content = paths(words.of((text or b"").split()), window, k)
                ids.append(np.full(len(low), doc))
                m.append(low)
                c.append(content)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (m, ids, c)], ["m", "doc_id", "content"])

    return each


def _maybe_repeated(window: int, k: int, shared):
    def each(batches):
        words, have = WordHashes(), shared.value
        for b in batches:
            ids, m = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), binary(b, "text"), strict=True):
                low = np.unique(paths(words.of((text or b"").split()), window, k)[2])
                low = low[in_map(have, low)]
                ids.append(np.full(len(low), doc))
                m.append(low)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(m).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], ["m", "doc_id"])

    return each


def _edges(window: int, k: int):
    """The distinct edges of a document's branching paths."""

    def each(batches):
        words = WordHashes()
        for b in batches:
            ids, e = [], []
            for doc, text, branch in zip(b.column("doc_id").to_pylist(), binary(b, "text"), b.column("branching").to_pylist(), strict=True):
                edges, starts, low, _ = paths(words.of((text or b"").split()), window, k)
                hit = np.isin(low.view(np.int64), np.array(branch, np.int64))
                own = np.unique(edges[np.repeat(hit, np.diff(np.append(starts, len(edges))))])
                ids.append(np.full(len(own), doc))
                e.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], ["e", "doc_id"])

    return each


def spans(n_words: int, gone: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by windows starting at ``gone``."""
    cover = np.zeros(n_words + 1, np.int32)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _cut(window: int, k: int, with_text: bool):
    def each(batches):
        words = WordHashes()
        for b in batches:
            out = []
            for text, whole, single in zip(binary(b, "text"), b.column("owned").to_pylist(), b.column("edges").to_pylist(), strict=True):
                w = (text or b"").split()
                n = len(w)
                if (whole or single) and n >= window:
                    edges, starts, low, _ = paths(words.of(w), window, k)
                    gone = np.repeat(np.isin(low.view(np.int64), np.array(whole or [], np.int64)), np.diff(np.append(starts, len(edges))))
                    gone |= np.isin(edges.view(np.int64), np.array(single or [], np.int64))
                    cover = spans(n, np.flatnonzero(gone), window)
                    w = [x for x, c in zip(w, cover.tolist(), strict=True) if not c]
                kept = b" ".join(w)
                out.append((n, n - len(w), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out]), pa.array([x[3] for x in out], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return each


def drop_repeated(docs: DataFrame, window: int = 13, k: int = 6, filter_bits: int = 1 << 26, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (what is left, words joined by a space; null unless with_text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = slim.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))
    rows = arrow_map(named, _path_rows(window, k), "m long, doc_id long, content long")
    seen = rows.groupBy("m").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last"), F.min("content").alias("_c"), F.max("content").alias("_d"))
    repeated = frozen(seen.where("owner < _last").select("m", "owner", (F.col("_c") == F.col("_d")).alias("plain")))
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(repeated, "m", filter_bits))
    found = arrow_map(named, _maybe_repeated(window, k, shared), "m long, doc_id long").join(repeated, "m").where("not plain or owner < doc_id")
    marks = frozen(found.groupBy("doc_id").agg(F.collect_list(F.when(F.col("plain"), F.col("m"))).alias("owned"), F.collect_list(F.when(~F.col("plain"), F.col("m"))).alias("branching")))
    marked = slim.join(marks, "doc_id", "left")
    loose = marked.where(F.size("branching") > 0).select("doc_id", "text", "branching")
    edges = frozen(arrow_map(loose, _edges(window, k), "e long, doc_id long"))
    owners = edges.groupBy("e").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last")).where("owner < _last")
    lost = edges.join(owners, "e").where("owner < doc_id").groupBy("doc_id").agg(F.collect_list("e").alias("edges"))
    last = marked.join(lost, "doc_id", "left").select("doc_id", "text", "owned", "edges")
    return arrow_map(last, _cut(window, k, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
