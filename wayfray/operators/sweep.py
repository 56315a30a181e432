"""Sweeps: one scenario grid for all levels, scopes, protocols, units, fractions and replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GLOBAL_COLUMNS, ZONE_COLUMNS
from .components import PER_TASK, frozen
from .deletion import deletions
from .trial import KEYS, diagnostics, memberships, one_pass, per_zone, surviving_labels, zone_columns, zone_labels


def global_table(counts: DataFrame, diag: DataFrame | None, label: str | None = None) -> DataFrame:
    """A row per level, scope and scenario. Cluster fractions are null under scope zone, where the graph is cut by construction."""
    n, d, m = F.sum("n_total"), F.sum("n_deleted"), F.sum("n_marooned")
    one = F.lit(1)
    own = (F.col("n_deleted") + F.col("n_marooned")) / F.greatest(F.col("n_total"), one)
    g = counts.groupBy(*KEYS, "level", "scope").agg(
        (d / F.greatest(n, one)).alias("frag_nominal"), ((d + m) / F.greatest(n, one)).alias("frag_effective"),
        (m / F.greatest(n, one)).alias("marooned_frac"), F.avg(own).alias("zone_mean_frag_effective"),
    )
    if diag is None:
        g = g.withColumns({"giant_frac": F.lit(None).cast("double"), "second_frac": F.lit(None).cast("double"), "n_components": F.lit(None).cast("bigint")})
    else:
        g = g.join(diag, KEYS)
        for c in ("giant_frac", "second_frac", "n_components"):
            g = g.withColumn(c, F.when(F.col("scope") == "county", F.col(c)))
    return g.withColumn("label", F.col("fips") if label is None else F.lit(label)).select(*GLOBAL_COLUMNS)


def zone_table(counts: DataFrame, zones: DataFrame, detail: list[float], label: str | None = None) -> DataFrame:
    """Replicate means by zone, only at the fractions asked for."""
    at = [round(p, 4) for p in detail]
    n = F.greatest(F.col("n_total"), F.lit(1))
    some = counts.where(F.round("p", 4).isin(*at)) if at else counts.where("false")
    agg = some.groupBy("fips", "level", "scope", "protocol", "unit", "p", "zone_idx").agg(
        F.max("n_total").alias("n_edges"), F.avg(F.col("n_deleted") / n).alias("frag_nominal"),
        F.avg(F.col("n_marooned") / n).alias("frag_marooned"), F.avg((F.col("n_deleted") + F.col("n_marooned")) / n).alias("frag_effective"),
    )
    named = agg.join(zones.select("fips", "level", "zone_idx", "zone_id"), ["fips", "level", "zone_idx"])
    return named.withColumn("label", F.col("fips") if label is None else F.lit(label)).select(*ZONE_COLUMNS)


def trials(net: DataFrame, edge_zone: DataFrame, zones: DataFrame, sc: DataFrame, scopes=("county",), strict: bool = False, table: dict[str, float] | None = None, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame | None]:
    """Counts by zone (as ``per_zone``) of all levels and scopes, and the diagnostics (None without scope county), of every scenario.

    Counties of up to ``per_task`` edges are counted in one pass over each scenario; larger ones by masks, distributed
    components and joins, made once for all levels and scopes."""
    largest = net.groupBy("fips").count().agg(F.max("count")).first()[0] or 0
    if largest <= per_task and "share" not in edge_zone.columns:
        levels = sorted(r["level"] for r in zones.select("level").distinct().collect())  # the levels asked for
        counts, diag = one_pass(deletions(frozen(zone_columns(net, edge_zone, levels)), sc, table), zones, levels, tuple(scopes), strict)
        return counts, diag if "county" in scopes else None
    zoned = frozen(memberships(net, edge_zone))
    gone = frozen(deletions(zoned, sc, table).select(*KEYS, "edge_id", "src", "dst", "length_m", "deleted", "_in"))
    labels = frozen(surviving_labels(gone, per_task)) if "county" in scopes else None
    counts = None
    for scope in scopes:
        c = per_zone(gone, edge_zone, zones, scope, strict, labels if scope == "county" else frozen(zone_labels(gone, edge_zone, strict, per_task)))
        counts = c if counts is None else counts.unionByName(c)
    return frozen(counts), diagnostics(gone, labels) if labels is not None else None


def sweep(net: DataFrame, edge_zone: DataFrame, zones: DataFrame, sc: DataFrame, scopes=("county",), detail=(0.20,), strict: bool = False, table: dict[str, float] | None = None, label: str | None = None, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """The global table and the zone table."""
    counts, diag = trials(net, edge_zone, zones, sc, scopes, strict, table, per_task)
    return global_table(counts, diag, label), zone_table(counts, zones, list(detail), label)
