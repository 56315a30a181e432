"""Toxicity by class-conditional Kneser-Ney models (operator 7).

Two models, toxic and ordinary, read a text in two units.

Expressions of one and two words: a class's probability of an expression comes from the
number of its labelled training documents that hold it, less a discount. What the discount
frees backs off: for words to the shared continuation counts (before how many kept words of
either class a word stands), for pairs to their words. These counts are Spark tables with a
row per expression, which grow with the labelled corpus; texts meet them in a join.

Spelling: a word's characters have class-conditional likelihoods (orders 1 to 4, inside the
word) whose lower orders are continuation counts shared by both classes, so that rare and
new words differ between the classes only as far as their characters do.

A text is described by length-normalised log-likelihood ratios: of its spelling over the
whole text, in its most toxic passage and of the words that speak for toxicity, and of its
expressions that do (ratio of e ** ``speaks`` or more). A logistic curve, fitted on labelled
rows that the first models have not seen, turns these into a score.

Size bounds: the tables of expressions have none and are joined. Characters fall into 48
symbols, so the spelling model is a table of 48**4 entries (21 MB); the curve is fitted on
at most ``fit_rows`` rows (20,000, the smallest hashes of their ids); bit maps of fixed size
thin out what reaches the exact joins, and when full cost only speed. Counts cover every
labelled training row.

Defined cases: null and empty texts get the score of a text without any evidence; rows
with no label are scored alike; a label given twice counts as toxic if any is; with no
training rows of a class all scores are 0.5 - tiny (predicted 0); repeated rows each give
a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, bit_map, frozen, gram_hashes, in_map

A, ORDER = 48, 4
SIZE = A**ORDER
PASSAGE = 16
_STRIP = ".,!?;:*&%$#|<>()[]{}\"'"


def _symbols() -> np.ndarray:
    """Symbol of each code point under 2048: 0 ends words, 1-26 letters, 27 digits, 28-46 other letters, 47 the rest."""
    s = np.full(2048, 47, np.uint8)
    s[128:] = 28 + np.arange(128, 2048) % 19
    s[48:58] = 27
    s[97:123] = np.arange(1, 27)
    s[10] = 0
    return s


_SYMBOL = _symbols()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words' character 4-grams, boundaries being symbol 0, and where each word's begin."""
    joined = "\n\n\n" + "\n\n\n\n".join(words) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.where(cp < 2048, _SYMBOL[np.minimum(cp, 2047)], 28 + cp % 19).astype(np.int32)
    g = ((s[:-3] * A + s[1:-2]) * A + s[2:-1]) * A + s[3:]
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate([[0], np.cumsum(n + 3)[:-1]]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first, n)
    return g[at], starts[:-1]


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for x in text.lower().replace("\x00", " ").split() if (w := x.strip(_STRIP))]


def log_ratios(ordinary: np.ndarray, toxic: np.ndarray, discount: float = 0.75, theta: float = 1.0) -> np.ndarray:
    """log P(symbol | context, toxic) - log P(symbol | context, ordinary) for every 4-gram."""
    cont = (ordinary + toxic) > 0
    shared = []
    for _ in range(ORDER - 1):  # how many symbols stand before each of the last 3, 2, 1 symbols
        cont = (cont > 0).reshape(A, -1).sum(0).astype(np.float64)
        shared.append(cont)
    low = np.full(A, 1.0 / A)
    for cont in reversed(shared):
        c = cont.reshape(-1, A)
        back = low.reshape(-1, A)[np.arange(len(c)) % max(1, len(low) // A)]
        total, types = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        low = np.where(total > 0, (np.maximum(c - discount, 0) + discount * types * back) / np.maximum(total, 1), back).reshape(-1)
    back = low.reshape(-1, A)  # of the last three symbols
    out = np.empty((A, A ** (ORDER - 2), A), np.float32)
    for first in range(A):  # one first symbol at a time, for memory
        p = []
        for counts in (toxic, ordinary):
            c = counts.reshape(A, -1, A)[first].astype(np.float64)
            total, types = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            p.append((np.maximum(c - discount, 0) + (discount * types + theta) * back) / (total + theta))
        out[first] = np.log(p[0]) - np.log(p[1])
    return out.reshape(-1)


class WordRatios(dict):
    """Word -> its log ratio, remembered while under ``most`` words."""

    def __init__(self, table: np.ndarray, most: int = 200_000):
        self.table, self.most = table, most

    def add(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            g, starts = grams(part)
            self.update(zip(part, np.add.reduceat(self.table[g].astype(np.float64), starts).tolist(), strict=True))


def features(ratios: np.ndarray) -> tuple[float, ...]:
    """Length-normalised evidence of a text from its words' log ratios."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    mean = ratios.mean()
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    passage = (sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE if n > PASSAGE else mean
    over = np.maximum(ratios - 2.0, 0.0)
    return float(mean), float(passage), float(over.mean()), float(over.max()), float(over.sum() / np.sqrt(n))


#: Five of the spelling, then one of the expressions.
N_FEATURES = 6
#: Bits of the maps of labelled ids and of expressions (16 MB).
MAP_BITS = 1 << 27
#: Parts that each kept expression is joined in, as one may stand in most documents.
SALTS = 8


def _counted(batches):
    """Top-order counts of a partition, by model (0: first models; 1: held from them) and class."""
    sums = np.zeros((4, SIZE), np.float32)
    words: dict[int, dict[str, int]] = {k: {} for k in range(4)}

    def flush(k):
        w = list(words[k])
        for i in range(0, len(w), 10_000):
            g, starts = grams(w[i : i + 10_000])
            times = np.fromiter((words[k][x] for x in w[i : i + 10_000]), np.float64, len(starts))
            at, inv = np.unique(g, return_inverse=True)
            sums[k][at] += np.bincount(inv, np.repeat(times, np.diff(np.append(starts, len(g))))).astype(np.float32)
        words[k] = {}

    for b in batches:
        for text, toxic, held in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fit")), strict=True):
            k = 2 * bool(held) + bool(toxic)
            d = words[k]
            for w in tokens(text):
                d[w] = d.get(w, 0) + 1
            if len(d) > 50_000:
                flush(k)
    for k in words:
        flush(k)
    at = np.flatnonzero(sums.any(0))
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(s[part].astype(np.float64)) for s in sums)], ["gram", "a0", "a1", "b0", "b1"])


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Ridge logistic regression by Newton's method, on standardised columns; coefficients for raw columns, then the constant."""
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), -1e-3)
    m, s = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - m) / s, np.ones(len(x))]
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((np.logaddexp(0, t) - y * t).sum() + 0.5 * ridge * w @ w)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step, now = np.linalg.solve(h, z.T @ (y - p) - ridge * w), loss(w)
        while np.abs(step).max() > 1e-9 and not loss(w + step) < now:  # a whole step may leap too far when classes are nearly apart
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
    return np.append(w[:-1] / s, w[-1] - (w[:-1] * m / s).sum())


def toxic_labels(labels: DataFrame) -> DataFrame:
    """key (the id as text), toxic."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return some.groupBy(F.col("doc_id").cast("string").alias("key")).agg((F.max("toxic") > 0).alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, text, toxic, fit of the training rows; fit rows are held from the first models.

    Only texts whose id a bit map of the labelled ids lets through are shuffled."""
    known = toxic_labels(labels)
    h = F.xxhash64("key").alias("h")
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(known.select(h), "h", MAP_BITS))

    def each(batches):
        for b in batches:
            yield b.filter(pa.array(in_map(shared.value, b.column("h").to_numpy().view(np.uint64)))).select(["key", "text"])

    some = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select(F.col("doc_id").cast("string").alias("key"), "text")
    met = arrow_map(some.select("key", "text", h), each, "key string, text string").join(known.hint("shuffle_hash"), "key")  # alike at every size, and texts need no sort
    return frozen(met.select(F.col("key").alias("id"), "text", "toxic", (fold("key") == 4).alias("fit")))


def expressions(words: list[str], hashes: WordHashes) -> list[tuple[np.ndarray, ...]]:
    """For orders 1 and 2 the distinct expressions of a text: hash, first and last word's hash."""
    w = hashes.of([x.encode("utf-8", "surrogatepass") for x in words])
    out = []
    for k in (1, 2):
        e, first = np.unique(w if k == 1 else gram_hashes(w, 2), return_index=True)
        out.append((e, w[first], w[first + k - 1]))
    return out


#: Expressions that a task holds before it passes their counts on.
HELD = 200_000


class _Tally:
    """Documents by expression: order, hash, first and last word, and counts outside and inside the fit rows."""

    NAMES = ("o", "e", "v", "l", "n0", "n1")

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, order: int, e: np.ndarray, v: np.ndarray, last: np.ndarray, held: bool) -> None:
        one, none = np.ones(len(e), np.int64), np.zeros(len(e), np.int64)
        self.parts.append((np.full(len(e), order, np.int64), e, v, last, none if held else one, one if held else none))
        self.size += len(e)

    def rows(self) -> pa.RecordBatch:
        o, e, v, last, n0, n1 = map(np.concatenate, zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 6
        self.parts, self.size = [], 0
        _, first, inv = np.unique(e, return_index=True, return_inverse=True)
        sums = [np.bincount(inv, n, len(first)).astype(np.int64) for n in (n0, n1)]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (o[first], e[first], v[first], last[first], *sums)], list(self.NAMES))


_TALLIED = "o long, e long, v long, l long, n0 long, n1 long"


def _tallied(shared=None):
    """Counts of a class's expressions; with a bit map only those it lets through, and per order a row of e null with the totals."""

    def each(batches):
        hashes, tally, totals = WordHashes(), _Tally(), np.zeros((2, 2), np.int64)
        for b in batches:
            for text, held in zip(b.column("text").to_pylist(), b.column("fit").to_pylist(), strict=True):
                for k, (e, v, last) in enumerate(expressions(tokens(text), hashes)):
                    totals[k, int(held)] += len(e)
                    ok = np.ones(len(e), bool) if shared is None else in_map(shared.value, e)
                    tally.add(k + 1, e[ok], v[ok], last[ok], held)
                if tally.size > HELD:
                    yield tally.rows()
        yield tally.rows()
        if shared is not None:
            null = pa.nulls(2, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1, 2]), null, null, null, pa.array(totals[:, 0]), pa.array(totals[:, 1])], list(_Tally.NAMES))

    return each


def expression_ratios(train: DataFrame, least: int = 3, speaks: float = 2.0, discount: float = 0.75) -> DataFrame:
    """e, r0, r1: expressions of ``least`` toxic documents or more and what they add to the log ratio of
    toxic against ordinary, under the first and the final models, where either is ``speaks`` or more.

    Kneser-Ney: P(w | class) = max(n(w) - D, 0) / N + s1 K(w) and P(vw | class) = max(n(vw) - D, 0) / N + s2 P(v | class) P(w | class),
    with n and N documents of the class by expression and their sum, K the shared continuation share, and
    s = D times the toxic class's distinct expressions / N, shared too. A pair adds what its words do not say."""
    count = lambda rows: rows.groupBy("o", "e").agg(F.min("v").alias("v"), F.min("l").alias("l"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    toxic = frozen(count(arrow_map(train.where("toxic").select("text", "fit"), _tallied(), _TALLIED)))
    sums = {r["o"]: r for r in toxic.groupBy("o").agg(F.sum("n0").alias("n0"), F.sum(F.col("n0") + F.col("n1")).alias("n1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count("*").alias("t1")).collect()}
    kept = toxic.where(F.col("n0") + F.col("n1") >= least)
    shared = train.sparkSession.sparkContext.broadcast(bit_map(kept, "e", MAP_BITS))
    ordinary = frozen(count(arrow_map(train.where("not toxic").select("text", "fit"), _tallied(shared), _TALLIED)))
    other = {r["o"]: r for r in ordinary.where("e is null").collect()}
    both = kept.join(ordinary.select("e", F.col("n0").alias("c0"), F.col("n1").alias("c1")), "e", "left").na.fill(0)
    both = frozen(both.select("o", "e", "v", "l", F.col("n0").alias("t0"), (F.col("n0") + F.col("n1")).alias("t1"), F.col("c0").alias("c0"), (F.col("c0") + F.col("c1")).alias("c1")))
    words, pairs = both.where("o = 1"), both.where("o = 2")
    before = pairs.groupBy(F.col("l").alias("e")).agg(F.count("*").alias("k"))
    all_k = max(1, both.count())

    def prob(m: int, order: int, n: str, total: int, low: Column) -> Column:
        freed = discount * sums[order][f"t{m}"] / max(1, sums[order][f"n{m}"]) if order in sums else discount
        return F.greatest(F.col(n) - discount, F.lit(0.0)) / max(1, total) + F.lit(freed) * low

    def totals(m: int, order: int) -> tuple[int, int]:
        c = other.get(order)
        return (sums[order][f"n{m}"] if order in sums else 0), ((c["n0"] + (c["n1"] if m else 0)) if c else 0)

    share = (F.coalesce("k", F.lit(0)) + 1) / all_k
    probs = [prob(m, 1, f"{c}{m}", totals(m, 1)[k], share).alias(f"p{c}{m}") for m in (0, 1) for k, c in enumerate("tc")]
    words = frozen(words.join(before, "e", "left").select("e", *probs))
    side = lambda c: words.select(F.col("e").alias(c), *(F.col(f"p{k}{m}").alias(f"{c}{k}{m}") for k in "tc" for m in (0, 1)))
    pairs = pairs.join(side("v"), "v").join(side("l"), "l")
    alone = [F.ln(F.col(f"pt{m}") / F.col(f"pc{m}")).alias(f"r{m}") for m in (0, 1)]
    together = []
    for m in (0, 1):
        t, c = (prob(m, 2, f"{k}{m}", totals(m, 2)[i], F.col(f"v{k}{m}") * F.col(f"l{k}{m}")) for i, k in enumerate("tc"))
        together.append((F.ln(t / c) - F.ln(F.col(f"vt{m}") / F.col(f"vc{m}")) - F.ln(F.col(f"lt{m}") / F.col(f"lc{m}"))).alias(f"r{m}"))
    out = words.select("e", *alone).union(pairs.select("e", *together))
    return frozen(out.where(F.greatest("r0", "r1") >= speaks))


def _described(model, which: int, shared, keep: list[str]):
    """Batches with text -> columns ``keep``, n (words), f (features of the spelling), es and ns (expressions that the map lets through, how often)."""
    known: list = []  # one for a task, as closures are shipped empty

    def each(batches):
        if not known:
            known.extend((WordRatios(model.value[which]), WordHashes()))
        ratios, hashes = known
        for b in batches:
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            found, es, ns = [], [], []
            for k in range(0, len(texts), 64):
                part = texts[k : k + 64]
                new = {w for t in part for w in t} - ratios.keys()
                if len(ratios) + len(new) > ratios.most:
                    ratios.clear()
                    new = {w for t in part for w in t}
                ratios.add(list(new))
                found += [features(np.fromiter(map(ratios.__getitem__, t), np.float64, len(t))) for t in part]
            for t in texts:
                w = hashes.of([x.encode("utf-8", "surrogatepass") for x in t])
                e = np.concatenate([w, gram_hashes(w, 2)])
                e, n = np.unique(e[in_map(shared.value, e)], return_counts=True)
                es.append(e.view(np.int64))
                ns.append(n.astype(np.int64))
            lists = [pa.array(c, pa.list_(t)) for c, t in ((found, pa.float64()), (es, pa.int64()), (ns, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([len(t) for t in texts], pa.int64()), *lists], [*keep, "n", "f", "es", "ns"])

    return each


def _evidence(texts: DataFrame, model, which: int, shared, table: DataFrame) -> DataFrame:
    """The columns of texts but text, and f (all features)."""
    keyed = texts.withColumn("_rid", F.monotonically_increasing_id())
    keep = [c for c in keyed.columns if c != "text"]
    kinds = dict(keyed.dtypes)
    rows = frozen(arrow_map(keyed, _described(model, which, shared, keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n long, f array<double>, es array<long>, ns array<long>"))
    hits = rows.select("_rid", F.explode(F.arrays_zip("es", "ns")).alias("x")).select("_rid", F.col("x.es").alias("e"), F.col("x.ns").alias("c"), F.pmod("_rid", F.lit(SALTS)).alias("s"))
    values = table.select("e", F.greatest(F.col(f"r{which}"), F.lit(0.0)).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    by = hits.hint("merge").join(values, ["e", "s"]).groupBy("_rid").agg(F.sum(F.col("c") * F.col("r")).alias("_s"))
    s, n = F.coalesce("_s", F.lit(0.0)), F.greatest("n", F.lit(1))
    f = F.concat("f", F.array(s / n))
    return rows.drop("es", "ns").hint("merge").join(by, "_rid", "left").select(*(c for c in keep if c != "_rid"), f.alias("f"))


def _spelling(train: DataFrame) -> list[np.ndarray]:
    """Log ratios of the first models and of the final ones."""
    names = ("a0", "a1", "b0", "b1")
    counted = arrow_map(train.select("text", "toxic", "fit"), _counted, "gram int, a0 double, a1 double, b0 double, b1 double")
    rows = counted.groupBy("gram").agg(*(F.sum(c).cast("float").alias(c) for c in names)).toArrow()  # at most 48**4 rows, a row for each 4-gram of symbols
    sums = np.zeros((4, SIZE), np.float32)
    at = rows.column("gram").to_numpy()
    for k, c in enumerate(names):
        sums[k][at] = rows.column(c).to_numpy()
    del rows, at
    first = log_ratios(sums[0], sums[1])
    sums[:2] += sums[2:]
    return [first, log_ratios(sums[0], sums[1])]


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """Per row: doc_id, th (hash of its text), score (0 to 1) and predicted (1 if score >= 0.5, else 0)."""
    sc = docs.sparkSession.sparkContext
    train = labelled(docs, labels)
    model = sc.broadcast(_spelling(train))
    table = expression_ratios(train)
    shared = sc.broadcast(bit_map(table, "e", MAP_BITS))
    fit = _evidence(train.where("fit").select("id", "toxic", "text"), model, 0, shared, table)
    sample = fit.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("toxic", "f").collect()
    x = np.array([r["f"] for r in sample], float).reshape(-1, N_FEATURES)
    w = _logistic(x, np.array([r["toxic"] for r in sample], float))
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    z = F.lit(float(w[-1]))
    for k in range(N_FEATURES):
        z = z + F.lit(float(w[k])) * F.get("f", F.lit(k))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = _evidence(slim, model, 1, shared, table).select("doc_id", "th", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """The rows of docs that the models don't predict toxic."""
    bad = scores(docs, labels, fit_rows).where("predicted = 1").select(F.col("doc_id").alias("_toxic_id"), F.col("th").alias("_toxic_th")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    same = F.col("_row")["doc_id"].eqNullSafe(F.col("_toxic_id")) & (F.xxhash64(F.col("_row")["text"]) == F.col("_toxic_th"))
    return rows.join(bad.hint("shuffle_hash"), same, "left_anti").select("_row.*")
