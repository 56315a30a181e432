"""Best-fit packing by exact complements (operator 3).

Texts become token ids; only those longer than a sequence are cut. The plan is made on the
histogram of piece lengths, which has at most ``room`` entries however many pieces there
are. Available lengths are indexed by the sums of their pairs. Longest first, a length takes
the single, pair or triple that fills its gap exactly, as often as the counts allow; what is
left is packed best fit, longest first. Exact triples can use up the short lengths that
best fit would need, so plans with fills of up to three, two, one and no lengths are made,
and the one of fewest sequences is taken. Pieces then find their place by their rank within their length, ranks being
prefix sums over hashed buckets, so no length is gathered in one task.

Defined cases: null and empty texts are the single id 0; rows with the same id are packed
each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, frozen


@lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The splitting pattern of tokenizers whose words can be encoded one by one (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that no normal form changes and whose lower case is that of each letter, and ``SPLIT`` for them in lower case.
LATIN, RUN = re.compile("[!-~À-ÖØ-öø-ÿ]+"), re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: Stands between words that are encoded together and are not of letters only; words that hold it are encoded alone.
_BETWEEN = "\x7f"
_GAP = " \x7f "
#: Words encoded at a time, and the longest that are remembered (characters).
TOGETHER, LONGEST = 250, 64


@lru_cache(1)
def parts_of(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a tokenizer folds case and splits at white space as ``WordIds`` relies on, and its added tokens in lower case."""
    s = json.loads(tokenizer(path).to_str())
    listed = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    norm, pre = listed(s["normalizer"], "normalizers"), listed(s["pre_tokenizer"], "pretokenizers")
    first = pre[0] if pre else {}
    fine = (
        [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
        and first.get("type") == "Split" and first["pattern"] == {"Regex": SPLIT} and (first["behavior"], first["invert"]) == ("Removed", True) and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in pre[1:])
    )
    return fine, tuple(x["content"].encode().lower().decode() for x in s["added_tokens"])


def bare_tokenizer(path: str):
    """The tokenizer of ``path`` for runs between spaces: without normaliser, splitting pattern and added tokens."""
    from tokenizers import Tokenizer

    s = json.loads(tokenizer(path).to_str())
    pre = s["pre_tokenizer"]
    rest = pre["pretokenizers"][1:] if pre["type"] == "Sequence" else []
    s |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
    return Tokenizer.from_str(json.dumps(s))


def batches_of(tok):
    return getattr(tok, "encode_batch_fast", tok.encode_batch)


class WordIds(dict):
    """Text between ASCII white space -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenizer never joins characters across white space, so a text's
    ids are those of its words, one after another. It also folds case, so words are taken
    in lower case. That holds for tokenizers of the form that ``parts_of`` looks for; with
    others, and for texts that hold an added token in any case (added tokens are matched in
    the raw text), whole texts are encoded. A batch's distinct words are looked up once;
    Latin words are encoded by their runs of letters, digits and signs, each run once.
    Memory is bounded by ``most`` words and runs, and those of a batch."""

    def __init__(self, path: str, most: int = 500_000):
        self.by_words, self.added = parts_of(path)
        self.encode, self.most = tokenizer(path).encode, most
        self.batch = batches_of(tokenizer(path))
        between = np.frombuffer(self[_BETWEEN], "<u4")
        self.between = int(between[0]) if len(between) == 1 else None
        suffix = (json.loads(tokenizer(path).to_str())["model"].get("end_of_word_suffix") or "") if self.by_words else ""
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # which ids end a run of letters, digits or signs
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.runs = batches_of(bare_tokenizer(path)) if self.ends.any() else None

    def __missing__(self, word: str) -> bytes:
        return pack_ids(self.encode(word, add_special_tokens=False).ids)

    def of_texts(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """The ids of each of an array of strings without nulls."""
        low, raw = pc.ascii_lower(texts), texts.cast(pa.binary())
        whole = np.full(len(texts), not self.by_words)
        for t in self.added:
            whole |= pc.match_substring(low, t).to_numpy(zero_copy_only=False)
        # combining marks may compose with a letter of either case: their texts stay as they are
        marked = pc.or_(pc.match_substring(raw, b"\xcc"), pc.match_substring(raw, b"\xcd"))
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", pc.if_else(marked, texts, low)))
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self.of_words(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        at = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])[lists.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"").cast("B")
        for k, alone in enumerate(whole.tolist()):
            yield self.__missing__(texts[k].as_py()) if alone else data[at[k] : at[k + 1]]

    def of_text(self, text: bytes) -> bytes:
        return bytes(next(self.of_texts(pa.array([text.decode()], pa.string()))))

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; the new ones are encoded together."""
        known = list(map(self.get, words))
        new = [k for k, ids in enumerate(known) if ids is None]
        if len(self) + len(new) > self.most:
            self.clear()
        self.learn([words[k] for k in new])
        for k in new:
            known[k] = self[words[k]]
        return known

    def learn(self, words: list[str]) -> None:
        """Encodes new words together and, but for the longest, remembers them.

        The last id of a run has the suffix of ends; so runs, and words that are one run of letters, need nothing between them."""
        latin, alone, plain, mixed = [], set(), [], []
        for w in words:
            if len(w) <= LONGEST:
                if self.runs and LATIN.fullmatch(w):
                    runs = RUN.findall(w.lower())
                    alone.update(runs)
                    if runs != [w]:
                        latin.append((w, runs))
                elif w.isalpha():
                    plain.append(w)
                elif w and _BETWEEN not in w:
                    mixed.append(w)
        self._by_ends(self.runs, [r for r in alone if r not in self])
        self.update((w, b"".join(map(self.__getitem__, runs))) for w, runs in latin)
        mixed += self._by_ends(self.batch, plain)
        for k in range(0, len(mixed) if self.between is not None else 0, TOGETHER):
            part = mixed[k : k + TOGETHER]
            ids = np.array(self.batch([_GAP.join(part)], add_special_tokens=False)[0].ids, "<u4")
            gaps = np.flatnonzero(ids == self.between)
            if len(gaps) == len(part) - 1:
                self._remember(part, ids, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(ids)]]))

    def _by_ends(self, batch, words: list[str]) -> list[str]:
        """Remembers words of one run each; returns those that did not come out as such."""
        left = []
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            ids = np.array(batch([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                self._remember(part, ids, np.concatenate([[0], stops[:-1]]), stops)
            else:
                left += part
        return left

    def _remember(self, words: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        raw = ids.tobytes()
        self.update((w, raw[a:b]) for w, a, b in zip(words, (4 * starts).tolist(), (4 * stops).tolist(), strict=True))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """Those of a Python worker, which outlive its tasks."""
    return WordIds(path)


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, path: str, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""

    def each(batches):
        words = word_ids(path)
        for b in batches:
            ids_col, out = b.column("doc_id").to_pylist(), ([], [], [], [], [])
            for doc, ids in zip(ids_col, words.of_texts(b.column("text").fill_null("")), strict=True):
                ids = b"".join((ids, bytes(4)))
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    piece = ids[at : at + 4 * room]
                    for c, v in zip(out, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        c.append(v)
            kinds = (b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select("doc_id", "text")
    return arrow_map(slim, each, f"doc_id {dict(slim.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """Lengths with their counts, indexed by the sums of pairs that are available."""

    def __init__(self, histogram: dict[int, int], room: int):
        self.room, self.left = room, {k: n for k, n in histogram.items() if n > 0}
        self.have = np.zeros(room + 1, bool)
        self.have[list(self.left)] = True
        self.pairs = np.zeros(2 * room + 1, np.int64)  # pairs a >= b of available lengths, by sum
        keys = np.array(sorted(self.left), np.int64)
        for i, k in enumerate(keys):
            self.pairs[k + keys[: i + 1]] += 1

    def fills(self, gap: int, parts: int) -> Iterator[tuple[int, ...]]:
        """Groups of ``parts`` available lengths that sum to gap, the longest first."""
        if parts == 1:
            if gap > 0 and self.have[gap]:
                yield (gap,)
        elif parts == 2:
            if gap > 1 and self.pairs[gap]:
                low = (gap + 1) // 2
                for a in np.flatnonzero(self.have[low:gap] & self.have[gap - low : 0 : -1])[::-1].tolist():
                    yield low + a, gap - low - a
        elif gap > 2:
            low = -(-gap // 3)
            for a in np.flatnonzero(self.have[low : gap - 1] & (self.pairs[gap - low : 1 : -1] > 0))[::-1].tolist():
                for b, c in self.fills(gap - low - a, 2):
                    if b <= low + a:
                        yield low + a, b, c

    def take(self, parts: tuple[int, ...]) -> int:
        """Uses a group as often as its lengths allow."""
        need = {k: parts.count(k) for k in set(parts)}
        n = min(self.left.get(k, 0) // m for k, m in need.items())
        for k, m in need.items() if n else ():
            self.left[k] -= n * m
            if not self.left[k]:
                del self.left[k]
                self.pairs[k + np.flatnonzero(self.have)] -= 1
                self.have[k] = False
        return n


def exact_fills(lengths: Lengths, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Full sequences of a length and up to ``most`` others, longest first; takes them from ``lengths``."""
    out = []
    for big in sorted(lengths.left, reverse=True):
        gap = lengths.room - big
        for parts in range(most + 1) if big in lengths.left else ():
            for group in lengths.fills(gap, parts) if parts else [()] * (gap == 0):
                if n := lengths.take((big, *group)):
                    out.append(((big, *group), n))
                if big not in lengths.left:
                    break
            if big not in lengths.left:
                break
    return out


def plan(histogram: dict[int, int], room: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), for counts of lengths up to room; of the plans with fills of three to no lengths the one of fewest sequences."""
    plans = []
    for most in (3, 2, 1, 0):
        lengths = Lengths(histogram, room)
        full = exact_fills(lengths, most)
        plans.append(full + best_fit(lengths.left, room))
    return min(plans, key=lambda p: sum(n for _, n in p))


def best_fit(left: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room for it."""
    keys: list[int] = []  # equal sequences are kept together: gap -> list of [parts, count]
    bins: dict[int, list[list]] = {}

    def put(parts: tuple[int, ...], n: int) -> None:
        gap = room - sum(parts)
        if gap not in bins:
            bins[gap] = []
            bisect.insort(keys, gap)
        bins[gap].append([parts, n])

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect.bisect_left(keys, size)
            if i == len(keys):
                each = room // size
                if n >= each:
                    put((size,) * each, n // each)
                if n % each:
                    put((size,) * (n % each), 1)
                break
            gap = keys[i]
            group = bins[gap][-1]
            fit = gap // size
            if n >= fit:
                m = min(group[1], n // fit)
                add = (size,) * fit
                used = fit * m
            else:
                m, add, used = 1, (size,) * n, n
            group[1] -= m
            parts = group[0]
            if not group[1]:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    keys.pop(i)
            put(parts + add, m)
            n -= used
    return [(tuple(p), n) for groups in bins.values() for p, n in groups]


def places(templates: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces of the length in a sequence, first slot; slot -> offset."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    offsets: dict[int, list[int]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for parts, n in templates:
        at, own = 0, {}
        for k in parts:
            own.setdefault(k, []).append(at)
            at += k
        for k, slots in own.items():
            o = offsets.setdefault(k, [])
            by.setdefault(k, []).append((rank.get(k, 0), sequence, len(slots), len(o)))
            o.extend(slots)
            rank[k] = rank.get(k, 0) + n * len(slots)
        sequence += n
    return {k: (*np.array(v, np.int64).T, np.array(offsets[k], np.int64)) for k, v in by.items()}


def pack(docs: DataFrame, path: str, room: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    p = frozen(pieces(docs, path, room))
    n = p.count()
    buckets = 1 << max(8, math.ceil(math.log2(max(1, n / 100_000))))
    p = p.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = frozen(p.groupBy("length", "_b").count())
    counts = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("count")).collect()}  # at most room rows
    model = p.sparkSession.sparkContext.broadcast(places(plan(counts, room)))  # at most the templates of room lengths
    before = F.sum("count").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    base = sums.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    placed = p.join(base, ["length", "_b"]).withColumn("_rank", F.col("_base") + own)

    def each(batches):
        of = model.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, sequence, per, slot, offsets = of[int(k)]
                i = np.searchsorted(first, rank[at], "right") - 1
                r = rank[at] - first[i]
                seq[at] = sequence[i] + r // per[i]
                off[at] = offsets[slot[i] + r % per[i]]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(p.dtypes)["doc_id"]
    p.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
