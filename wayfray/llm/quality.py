"""Host-level quality rules (operator 5).

Per text: counts over all its words and lines. Each rule has two levels: a text may fail it,
or be doubtful by it. Per host (the source) and rule: the share of its documents that the rule
doubts, shrunk by a beta prior whose two parameters come from the spread of the hosts' own
shares (method of moments). The verdicts of the host join back: a doubtful text goes if its
host stands out by that rule, and stays elsewhere.

Defined cases: null and empty texts have 0 in every count and fail the base rule; a null
host is a host of its own; repeated rows count as often as they stand; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, binary, frozen, gram_hashes, null_safe

#: Symbols that the contract counts.
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
_SPACE = bytes([32, 9, 10, 11, 12, 13])


def repeated_words(hashes: np.ndarray, k: int = 3) -> int:
    """Words that lie in a k-word window found twice or more in the text."""
    g = gram_hashes(hashes, k)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_counts(text: bytes | None, words: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    parts = text.split()
    inside = text.translate(None, _SPACE)
    chars = len(inside) - sum(np.bincount(np.frombuffer(inside, np.uint8) >> 6, minlength=4)[2:3].tolist())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(parts), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words.of(parts))


def _each(batches):
    words = WordHashes()
    for b in batches:
        rows = [text_counts(t, words) for t in binary(b, "text")]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_g"), *cols], ["doc_id", "_g", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def counts(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", null_safe("source").alias("_g"), "text")
    kind = dict(slim.dtypes)["doc_id"]
    return arrow_map(slim, _each, f"doc_id {kind}, _g string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


#: Parts that a host's documents meet its verdict in.
SALTS = 32
#: Rules: (a text that fails it goes, a text that is only doubtful by it goes with its host).
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols > n_words"),
    "word length": ("word_chars > 15 * n_words or word_chars < 2 * n_words", "word_chars > 12 * n_words or word_chars < 3 * n_words"),
    "repeated lines": ("n_dup_lines > 3 and 4 * n_dup_lines > n_words", "n_dup_lines > 1 and 20 * n_dup_lines > n_words"),
    "repeated words": ("100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words > 20 * n_words"),
}
#: Standard deviations of the shrunk rates that a host's rate may stand above their mean; what rounding may add.
STANDS_OUT, ROUNDING = 1.0, 1e-9


def host_verdicts(rated: DataFrame, rules: list[str], most: float = 0.5) -> DataFrame:
    """_g, host_rate, host_ok and, for each column of ``rules``, bad_<column>. rated: _g, _failed and the rules' columns (boolean).

    The share of a host's documents that a rule doubts is shrunk to (doubted + a) / (documents + a + b);
    a and b come from the mean m and the variance v of the hosts' shares, a + b = m (1 - m) / v - 1, at
    least 1. A host is bad by a rule if its rate stands out from the hosts' rates, and not ok at all if its
    rate of failures exceeds ``most``."""
    cols = ["_failed", *rules]
    by = rated.groupBy("_g").agg(F.count("*").alias("_n"), *(F.sum(F.col(c).cast("int")).alias(f"_k{c}") for c in cols))
    share = {c: F.col(f"_k{c}") / F.col("_n") for c in cols}
    prior = by.agg(*(F.avg(p).alias(f"_m{c}") for c, p in share.items()), *(F.coalesce(F.var_pop(p), F.lit(0.0)).alias(f"_v{c}") for c, p in share.items()))
    known = by.crossJoin(F.broadcast(prior))  # one row
    rates = {}
    for c in cols:
        m, v = F.col(f"_m{c}"), F.col(f"_v{c}")
        weight = F.when(v > 0, F.greatest(F.lit(1.0), m * (1 - m) / v - 1)).otherwise(F.lit(1e6))
        rates[f"_r{c}"] = (F.col(f"_k{c}") + m * weight) / (F.col("_n") + weight)
    known = known.withColumns(rates)
    spread = known.agg(*(F.sqrt(F.avg((F.col(f"_r{c}") - F.col(f"_m{c}")) * (F.col(f"_r{c}") - F.col(f"_m{c}")))).alias(f"_d{c}") for c in rules))
    out = known.crossJoin(F.broadcast(spread))  # one row
    bad = [(F.col(f"_r{c}") > F.col(f"_m{c}") + STANDS_OUT * F.col(f"_d{c}") + ROUNDING).alias(f"bad_{c}") for c in rules]
    return out.select("_g", F.col("_r_failed").alias("host_rate"), (F.col("_r_failed") <= most).alias("host_ok"), *bad)


def judge(docs: DataFrame, min_words: int = 50, most_repeated: int = 50, host_most: float = 0.5, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Per document: its counts, base_failed, rule_failed, host_rate, host_failed, kept.

    kept: the base rule passes, no rule fails, the host's rate of failures is at most ``host_most``, and
    of the rules that doubt the text none is one by which its host stands out (host_failed)."""
    rules = RULES if rules is None else rules
    c = frozen(counts(docs))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    fails = F.expr(" or ".join(f"({r})" for r, _ in rules.values()))
    doubts = [f"_doubt{i}" for i in range(len(rules))]
    rated = c.withColumns({"base_failed": base, "rule_failed": fails, **{d: F.expr(f"({fail}) or ({doubt})") for d, (fail, doubt) in zip(doubts, rules.values(), strict=True)}})
    rated = rated.withColumn("_failed", F.col("base_failed") | F.col("rule_failed"))
    verdicts = host_verdicts(rated, doubts, host_most).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a host may have most documents
    out = rated.withColumn("_s", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(verdicts, ["_g", "_s"]).drop("_s")
    by_host = F.lit(False)
    for d in doubts:
        by_host = by_host | (F.col(d) & F.col(f"bad_{d}"))
    out = out.withColumn("host_failed", ~F.col("host_ok") | by_host)
    return out.withColumn("kept", ~F.col("_failed") & ~F.col("host_failed")).drop(*doubts, *(f"bad_{d}" for d in doubts))
