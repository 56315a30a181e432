"""MinHash near-dedup by a multi-index Hamming join (operator 10).

Texts with the same shingle set are one class. A class has a signature of ``chunks`` times
``symbols`` minima, each cut to 16 bits. Two signatures that differ in at most
2 * chunks - 1 symbols agree, by pigeonhole, in some chunk but for one symbol; every chunk
is indexed with each of its symbols left out in turn, so all such pairs meet in a bucket.
(At a similarity of 0.8 the expected difference is a fifth of the symbols; with 14 chunks
of 5 a pair misses all buckets with probability 8e-9.)

No bucket emits its pairs. First each bucket's head, the class that meets most others, is
checked against the rest and components are formed. Then only buckets that still hold
several components compare members of different components, block by block, and emit no
more than a spanning forest of links; members travel as their differences from the head's
set, from which two members' whole sets are compared exactly. Every check is on whole
shingle sets.

Defined cases: null, empty and word-less texts have an empty set, no link, and are kept; a
text of fewer words than a shingle is one shingle; repeated rows are copies of each other
and each gives a row; rows with a null doc_id take part, but name no component that has a
named row, and are kept only where none has; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from .common import WordHashes, arrow_map, binary, frozen, gram_hashes

CHUNKS, SYMBOLS = 14, 5
H = CHUNKS * SYMBOLS
#: Signatures of sets with similarity 0.8 differ in more symbols with a probability under 1e-7.
MOST_DIFFERENT = 36
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, H, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, H, np.uint64)
_SALT = _rng.integers(0, 2**63, (CHUNKS, SYMBOLS), np.uint64)
#: Members of a bucket that are compared at a time.
BLOCK = 4096
#: Numbers in which all members of a block together differ from the head (8 MB).
BLOCK_SIZE = 1 << 20
#: Parts that a component's classes meet its id in.
SALTS = 32


def shingles(text: bytes | None, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z lower-cased."""
    w = words.of((text or b"").lower().split())
    if not len(w):
        return w
    return np.unique(gram_hashes(w, k)) if len(w) >= k else gram_hashes(w, len(w))


def signature(s: np.ndarray) -> bytes:
    low = np.full(H, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        m = np.multiply.outer(_A, s[i : i + 4096])
        m += _B[:, None]
        np.minimum(low, m.min(axis=1), out=low)
    low ^= low >> np.uint64(31)  # the leading bits of a minimum say little
    return (low & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def bucket_keys(signatures: list[bytes]) -> np.ndarray:
    """For each signature a key per chunk and symbol left out."""
    s = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, CHUNKS, SYMBOLS).astype(np.uint64)
    out = np.empty((len(s), CHUNKS, SYMBOLS), np.uint64)
    for p in range(SYMBOLS):
        k = np.zeros((len(s), CHUNKS), np.uint64)
        for j in range(SYMBOLS):
            if j != p:
                k = (k << np.uint64(16)) | s[:, :, j]
        k = (k ^ _SALT[None, :, p]) * np.uint64(0x9E3779B97F4A7C15)
        out[:, :, p] = k ^ (k >> np.uint64(32))
    return out.reshape(len(s), -1).view(np.int64)


def _described(k: int):
    def each(batches):
        words = WordHashes()
        for b in batches:
            sets = [shingles(t, words, k) for t in binary(b, "text")]
            fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "th", "n_shingles", "fp", "sig"],
            )

    return each


def _keys(batches):
    for b in batches:
        if b.num_rows:
            keys = bucket_keys(b.column("sig").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(list(keys), pa.list_(pa.int64()))], ["c", "keys"])


def _alike(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures and set sizes let a pair through to the check."""
    near = (sa != sb).sum(-1) <= MOST_DIFFERENT
    return near & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _prefiltered(percent: int):
    def each(batches):
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, H) for c in ("sa", "sb"))
                ok = pa.array(_alike(sa, sb, b.column("na").to_numpy(), b.column("nb").to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([b.column("x").filter(ok), b.column("y").filter(ok)], ["x", "y"])

    return each


def spanning_links(comp: np.ndarray, n: np.ndarray, deltas: list[np.ndarray], blk: np.ndarray, percent: int):
    """Links between members of different components, enough to join all that are linked.

    A member is given by the size of its set and by how the set differs from the bucket's
    head; two members differ by the symmetric difference of these, counted through an
    inverted index. Of two blocks only pairs across them count. Every pair of different
    components has a member outside the largest one, so only those look for partners."""
    root = {x: x for x in comp.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    m = len(comp)
    own = np.array([len(d) for d in deltas])
    _, value = np.unique(np.concatenate(deltas), return_inverse=True)
    order = np.argsort(value, kind="stable")
    member = np.repeat(np.arange(m), own)[order]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(value))]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(own)])
    names, sizes = np.unique(comp, return_counts=True)
    two = blk.min() != blk.max()
    for i in np.flatnonzero(comp != names[sizes.argmax()]).tolist():
        v = value[first[i] : first[i + 1]]
        lens = ptr[v + 1] - ptr[v]
        at = np.repeat(ptr[v] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        apart = own[i] + own - 2 * np.bincount(member[at], minlength=m)
        ok = (comp != comp[i]) & (100 * (n + n[i] - apart) >= percent * (n + n[i] + apart))
        if two:
            ok &= blk != blk[i]
        for j in np.flatnonzero(ok).tolist():
            mine, other = find(int(comp[i])), find(int(comp[j]))
            if mine != other:
                yield i, j
                root[other] = mine


def _within(percent: int):
    def each(batches):
        for b in batches:
            xs, ys = [], []
            for g in range(b.num_rows):
                members = b.column("members")[g].values
                c, comp, n, blk = (members.field(k).to_numpy(zero_copy_only=False) for k in ("c", "comp", "n", "blk"))
                if (comp == comp[0]).all():
                    continue
                lists = members.field("delta")
                numbers, at = lists.values.to_numpy(), lists.offsets.to_numpy()
                deltas = [numbers[i:j] for i, j in itertools.pairwise(at.tolist())]
                for i, j in spanning_links(comp, n, deltas, blk, percent):
                    xs.append(int(c[i]))
                    ys.append(int(c[j]))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return each


def _sets(k: int):
    def each(batches):
        words = WordHashes()
        for b in batches:
            sets = [shingles(t, words, k) for t in binary(b, "text")]
            ok = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == f for s, f in zip(sets, b.column("fp").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("c").filter(ok), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())).filter(ok)], ["c", "s"])

    return each


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """c, s: the whole shingle sets of the classes in ids, each from its document of least id, or one without an id."""
    who = classes.join(ids, "c", "left_semi").select(F.col("rep").alias("doc_id"), "c", "fp", "th")
    texts = docs.select("doc_id", "text").join(who.where("doc_id is not null").hint("shuffle_hash"), "doc_id").select("c", "fp", "text")
    unnamed = docs.where(F.col("doc_id").isNull() & F.col("text").isNotNull()).select(F.xxhash64("text").alias("th"), "text").dropDuplicates(["th"])
    texts = texts.union(unnamed.join(who.where("doc_id is null"), "th").select("c", "fp", "text"))
    return frozen(arrow_map(texts, _sets(k), "c long, s array<long>").dropDuplicates(["c"]))


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y with their sets a, b."""
    return pairs.join(sets.select(F.col("c").alias("x"), F.col("s").alias("a")), "x").join(sets.select(F.col("c").alias("y"), F.col("s").alias("b")), "y")


def classes_of(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, fp; th: hash of the text) and classes (c, fp, rep, th, n, sig)."""
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = frozen(arrow_map(slim, _described(k), f"doc_id {dict(slim.dtypes)['doc_id']}, th long, n_shingles long, fp binary, sig binary"))
    by = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("th").alias("th"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"))
    return rows, frozen(by.withColumn("c", F.monotonically_increasing_id()))


def linked_classes(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label: classes with links and their components."""
    index = arrow_map(classes.select("c", "sig"), _keys, "c long, keys array<long>").select("c", F.explode("keys").alias("key"))
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = frozen(index.join(shared, "key"))
    # the head of a bucket: its class that meets most others, which near copies of one text have in common
    weight = met.groupBy("c").agg(F.sum("n").alias("w"))
    heads = met.join(weight, "c").groupBy("key").agg(F.max(F.struct("w", "c")).getField("c").alias("x"))
    met = frozen(met.join(heads, "key"))
    side = lambda c, s, n: classes.select(F.col("c").alias(c), F.col("sig").alias(s), F.col("n").alias(n))
    star = met.where("c <> x").select("x", F.col("c").alias("y")).distinct()
    near = frozen(arrow_map(star.join(side("x", "sa", "na"), "x").join(side("y", "sb", "nb"), "y"), _prefiltered(percent), "x long, y long"))
    wanted = near.select(F.explode(F.array("x", "y")).alias("c")).union(met.where("n > 2").select("c")).distinct()
    sets = _sets_of(docs, classes, wanted, k)
    common = F.size(F.array_intersect("a", "b"))
    first = frozen(_both(near, sets).where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("x", "y"))
    comp = frozen(star_components(first, src="x", dst="y", tidy=1))
    # buckets of three or more classes that still hold several components; equal buckets once
    placed = met.where("n > 2").join(comp.withColumnRenamed("node", "c"), "c", "left").select("key", "n", "x", "c", F.coalesce("label", "c").alias("comp"))
    alike = placed.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.max("x").alias("_x"), F.count("*").alias("_n"), F.bit_xor(F.xxhash64("c")).alias("_h"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("_g"))
    mixed = alike.where("_a < _b").groupBy("_x", "_n", "_h", "_g").agg(F.min("key").alias("key")).select("key")
    held = frozen(placed.join(mixed, "key", "left_semi"))
    apart = F.concat(F.array_except("a", "b"), F.array_except("b", "a"))
    deltas = frozen(_both(held.where("x <> c").select("x", F.col("c").alias("y")).distinct(), sets).select("x", F.col("y").alias("c"), apart.alias("delta")))
    held = held.join(deltas, ["x", "c"], "left").withColumn("delta", F.coalesce("delta", F.array().cast("array<bigint>")))
    bulk = held.groupBy("key").agg(F.sum(F.size("delta") + 1).alias("_bulk"))
    held = held.join(bulk, "key").withColumn("nb", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("_bulk") / BLOCK_SIZE)).cast("int")).withColumn("blk", F.pmod(F.hash("c", "key"), F.col("nb")))
    held = held.join(classes.select("c", F.col("n").alias("size")), "c")
    met_by = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(F.col("blk"), j).alias("i"), F.greatest(F.col("blk"), j).alias("j")))
    dealt = held.withColumn("at", F.explode(met_by))
    groups = dealt.groupBy("key", "at").agg(F.collect_list(F.struct("c", "comp", F.col("size").alias("n"), "delta", "blk")).alias("members"))
    more = frozen(arrow_map(groups.select("members"), _within(percent), "x long, y long", batch=8))
    return star_components(first.union(more), src="x", dst="y", tidy=1)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, th (hash of its text), n_shingles, component_id (the smallest doc_id linked, itself included), kept."""
    rows, classes = classes_of(docs, k)
    comp = linked_classes(docs, classes, k, percent)
    named = classes.join(comp.withColumnRenamed("node", "c"), "c", "left").select("c", "fp", "rep", "label").withColumn("_s", F.pmod("c", F.lit(SALTS)).cast("int"))
    least = named.where("label is not null").groupBy("label").agg(F.min("rep").alias("component"))
    least = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = named.join(least, ["label", "_s"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = rows.join(of, "fp", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the component's id, once. Rows with a null id stay where no named row is linked."""
    keep = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("__near_id"), F.col("th").alias("__near_th")).distinct()
    keep = frozen(keep)  # what led to it goes before the texts move
    th = F.xxhash64("text")
    one = docs.join(keep.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__near_id")) & (th == F.col("__near_th")), "left_semi")
    named = one.where(F.col("doc_id").isNotNull()).withColumn("__near_th", th).dropDuplicates(["doc_id", "__near_th"]).drop("__near_th")
    return named.unionByName(one.where(F.col("doc_id").isNull()))
