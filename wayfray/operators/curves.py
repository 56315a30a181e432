"""Rank curves, percolation thresholds, score curves and their power fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import close_to

GROUP = ["fips", "level", "scope", "protocol", "unit"]


def rank_curves(zone: DataFrame, p: float = 0.20) -> DataFrame:
    """zone rows at p with norm_rank, (place - 1/2) / n by rising frag_effective, ties by zone_id."""
    w = W.partitionBy(*GROUP)
    return zone.where(close_to(F.col("p"), p)).withColumn("norm_rank", (F.row_number().over(w.orderBy("frag_effective", "zone_id")) - 0.5) / F.count("*").over(w))


def curve_summary(curves: DataFrame) -> DataFrame:
    """n_zones, median_frag, rank_at_50pct, tail_slope_ols for each curve."""
    x, f = F.col("norm_rank"), F.col("frag_effective")
    tail = x > 0.6
    ok = tail & (1 - x > 0) & (1 - f > 0)
    slope = F.regr_slope(F.when(ok, F.ln(1 - f)), F.when(ok, F.ln(1 - x)))
    enough = (F.count_if(tail) > 5) & (F.count_if(ok) > 5)
    return curves.groupBy(*GROUP).agg(
        F.count("*").alias("n_zones"), F.median("frag_effective").alias("median_frag"),
        F.min(F.when(f >= 0.5, x)).alias("rank_at_50pct"), F.when(enough, slope).alias("tail_slope_ols"),
    )


def percolation_means(glob: DataFrame) -> DataFrame:
    """Replicate means by p of each curve, for plots and thresholds."""
    cols = ("giant_frac", "second_frac", "frag_nominal", "frag_effective", "marooned_frac")
    return glob.groupBy(*GROUP, "p").agg(*(F.avg(c).alias(c) for c in cols))


def estimate_pc(glob: DataFrame) -> DataFrame:
    """pc_second_peak (the p of the largest mean second cluster, the least of equals), max_second_frac, pc_giant_half."""
    m = percolation_means(glob.where("scope = 'county'"))
    return (
        m.groupBy(*GROUP)
        .agg(F.min(F.struct((-F.col("second_frac")).alias("s"), "p")).alias("b"), F.max("second_frac").alias("max_second_frac"), F.min(F.when(F.col("giant_frac") < 0.5, F.col("p"))).alias("pc_giant_half"), F.count("second_frac").alias("n"))
        .where("n > 0").select(*GROUP, F.col("b.p").alias("pc_second_peak"), "max_second_frac", "pc_giant_half")
    )


def county_summary(curves: DataFrame, glob: DataFrame, network: DataFrame) -> DataFrame:
    """Curve summaries with thresholds (null where there are none) and the network's figures."""
    return curve_summary(curves).join(estimate_pc(glob), GROUP, "left").join(network, "fips")


def scored(zone: DataFrame, level: str | None = None, scope: str | None = None) -> DataFrame:
    """Marooned edges, score per thousand, rank from 1 and norm_rank = rank / n by rising score, ties by zone_id.

    Tables without frag_marooned are scored by frag_effective."""
    for c, v in (("level", level), ("scope", scope)):
        if v is not None and c in zone.columns:
            zone = zone.where(F.col(c) == v)
    rate = "frag_marooned" if "frag_marooned" in zone.columns else "frag_effective"
    by = [c for c in ("fips", "level", "scope") if c in zone.columns]
    w = W.partitionBy(*by)
    s = zone.withColumns({"marooned": F.col(rate) * F.col("n_edges"), "score": F.col(rate) * 1000.0})
    s = s.withColumn("rank", F.row_number().over(w.orderBy("score", "zone_id")))
    return s.withColumn("norm_rank", F.col("rank") / F.count("*").over(w))


def power_fit(points: DataFrame, by: list[str], x: str = "rank", y: str = "score") -> DataFrame:
    """by..., n_zones, a, b, r2, xmax of y = a x^b, fitted in logarithms where both are positive, r2 in plain units; groups of fewer than two such points have none."""
    ok = (F.col(x) > 0) & (F.col(y) > 0)
    lx, ly = F.when(ok, F.ln(x)), F.when(ok, F.ln(y))
    fit = points.groupBy(*by).agg(F.count("*").alias("n_zones"), F.regr_slope(ly, lx).alias("b"), F.exp(F.regr_intercept(ly, lx)).alias("a"), F.avg(F.when(ok, F.col(y))).alias("_mean"), F.count(lx).alias("_n"), F.max(x).alias("xmax")).where("_n >= 2")
    e = points.where(ok).join(fit, by)
    res = F.sum(F.pow(F.col(y) - F.col("a") * F.pow(F.col(x), F.col("b")), F.lit(2)))
    tot = F.sum(F.pow(F.col(y) - F.col("_mean"), F.lit(2)))
    r2 = e.groupBy(*by).agg(F.when(tot != 0, 1 - res / tot).alias("r2"))
    return fit.join(r2, by).select(*by, "n_zones", "a", "b", "r2", "xmax")


def overlay(fits: DataFrame) -> DataFrame:
    """Fits in units of the normalised rank, by rising exponent."""
    return fits.withColumn("a_norm", F.col("a") * F.pow("xmax", "b")).orderBy("b")


def overlay_points(scores: DataFrame, fits: DataFrame) -> DataFrame:
    """Every county's scores over the normalised rank, beside the curve fitted to them."""
    x = F.when(F.col("xmax") > 1, F.col("norm_rank") * F.col("xmax")).otherwise(F.col("norm_rank"))
    return scores.join(fits.select("fips", "a", "b", "xmax"), "fips").select("fips", "zone_id", "norm_rank", "score", (F.col("a") * F.pow(x, F.col("b"))).alias("fitted"))
