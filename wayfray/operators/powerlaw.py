"""Cluster-size distributions: pooled sizes, the CCDF, and the maximum-likelihood power law.

Everything works on histograms (size, n), so pools of any size fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import TAU_2D
from .deletion import deletions, scenarios
from .trial import clusters, surviving_labels


def cluster_sizes(net: DataFrame, p: float, replicates: int = 20, seed: int = 0, protocol: str = "random", unit: str = "edge") -> DataFrame:
    """fips, protocol, unit, p, replicate, size of every surviving component, under a stream of draws of its own."""
    sc = scenarios(net.sparkSession, [p], replicates, (protocol,), (unit,), seed, "|7")
    return clusters(surviving_labels(deletions(net, sc))).select("fips", "protocol", "unit", "p", "replicate", "size")


def histogram(sizes: DataFrame, by: list[str]) -> DataFrame:
    return sizes.where("size > 0").groupBy(*by, "size").agg(F.count("*").alias("n"))


def ccdf(hist: DataFrame, by: list[str]) -> DataFrame:
    """by..., size, n, ccdf: the share of clusters at least as large."""
    w = W.partitionBy(*by)
    at_least = F.sum("n").over(w.orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0))
    return hist.withColumn("ccdf", at_least / F.sum("n").over(w))


def candidates(hist: DataFrame, by: list[str], most: int | None = 200, spare: int = 10) -> DataFrame:
    """by..., xmin: all distinct sizes but the ``spare`` largest, thinned evenly to ``most``, or whole with None.

    Of k distinct sizes a fit meets k * (k + 1) / 2 pairs, which for cluster sizes are no more than the pooled nodes."""
    w = W.partitionBy(*by)
    c = hist.select(*by, "size").withColumns({"_i": F.row_number().over(w.orderBy("size")) - 1, "_n": F.count("*").over(w) - spare}).where("_i < _n")
    if most is None:
        return c.select(*by, F.col("size").alias("xmin"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (most - 1)))
    return c.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i").cast("bigint"))).select(*by, F.col("size").alias("xmin"))


def fit_powerlaw(hist: DataFrame, by: list[str], xmins: DataFrame | None = None, least: int = 20) -> DataFrame:
    """by..., alpha, xmin, n_tail, ks: of the candidate xmin the fit of least KS distance (the least xmin of equals).

    Pools under ``least`` give n_tail 0 and nulls; pools without a valid candidate ks infinite."""
    cand = candidates(hist, by) if xmins is None else xmins
    total = hist.groupBy(*by).agg(F.sum("n").alias("_total"))
    tail = cand.join(hist, by).where("size >= xmin").withColumn("_ratio", F.col("size") / (F.col("xmin") - 0.5))
    alpha = tail.groupBy(*by, "xmin").agg(F.sum("n").alias("n_tail"), F.sum(F.col("n") * F.ln("_ratio")).alias("_l")).where(F.col("n_tail") >= least)
    alpha = alpha.withColumn("alpha", 1 + F.col("n_tail") / F.col("_l")).drop("_l")
    run = F.sum("n").over(W.partitionBy(*by, "xmin").orderBy("size").rowsBetween(W.unboundedPreceding, 0))
    d = tail.withColumn("_run", run).join(alpha, [*by, "xmin"])
    theory = 1 - F.pow("_ratio", 1 - F.col("alpha"))
    ks = F.greatest(F.abs((F.col("_run") - F.col("n")) / F.col("n_tail") - theory), F.abs((F.col("_run") - 1) / F.col("n_tail") - theory))
    fits = d.withColumn("_ks", ks).groupBy(*by, "xmin", "n_tail", "alpha").agg(F.max("_ks").alias("ks"))
    best = fits.groupBy(*by).agg(F.min(F.struct("ks", "xmin", "alpha", "n_tail")).alias("f")).select(*by, "f.*")
    out = total.join(best, by, "left")
    few = F.col("_total") < least
    return out.select(
        *by, F.when(~few, F.col("alpha")).alias("alpha"), F.when(~few, F.col("xmin").cast("double")).alias("xmin"),
        F.when(few, F.lit(0)).otherwise(F.coalesce("n_tail", F.lit(0))).cast("bigint").alias("n_tail"),
        F.when(~few, F.coalesce("ks", F.lit(float("inf")))).alias("ks"),
    )


def critical_exponent(net: DataFrame, pc: float, replicates: int = 20, seed: int = 0) -> DataFrame:
    """The power law of cluster sizes at pc, beside the theoretical exponent."""
    hist = histogram(cluster_sizes(net, pc, replicates, seed), ["fips"])
    return fit_powerlaw(hist, ["fips"]).withColumns({"p": F.lit(pc), "tau_2d_reference": F.lit(TAU_2D)})


def fitted_tail(fit: DataFrame, hist: DataFrame, by: list[str]) -> DataFrame:
    """Points of the fitted tail on the CCDF, for plots."""
    total = hist.groupBy(*by).agg(F.sum("n").alias("_total"))
    y = F.col("n_tail") / F.col("_total") * F.pow(F.col("size") / F.col("xmin"), 1 - F.col("alpha"))
    return hist.join(fit, by).join(total, by).where("size >= xmin").select(*by, "size", y.alias("fitted"))
