"""Trials: components of what survives, marooned edges by zone, clusters of the whole network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import SCENARIO
from .components import PER_TASK, _min_labels, components, frozen

KEYS = ["fips", *SCENARIO]


def surviving_labels(deleted: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Scope county: fips, scenario, node, label of the surviving edges' ends. Graphs of more than ``per_task`` edges are contracted task by task and labelled in rounds, all scenarios at once."""
    return components(deleted.where(~F.col("deleted")), KEYS, _largest(deleted), per_task)


def _largest(deleted: DataFrame) -> int:
    """Edges of the largest county, surviving or not."""
    return deleted.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0


def zone_labels(deleted: DataFrame, edge_zone: DataFrame, strict: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """Scope zone: paths stay in their zone. Edges in no zone count to zone 0, or with ``strict`` to none."""
    z = edge_zone.where("zone_idx is not null") if strict else edge_zone.withColumn("zone_idx", F.coalesce("zone_idx", F.lit(0)))
    kept = deleted.where(~F.col("deleted")).select(*KEYS, "edge_id", "src", "dst").join(z.drop("share"), ["fips", "edge_id"])
    largest = z.groupBy("fips", "level", "zone_idx").count().agg(F.max("count")).first()[0] or 0
    return components(kept, [*KEYS, "level", "zone_idx"], largest, per_task)


def memberships(net: DataFrame, edge_zone: DataFrame) -> DataFrame:
    """net with _in, the zones an edge counts to: level, zone_idx, share."""
    share = F.col("share") if "share" in edge_zone.columns else F.lit(1)  # edges may count to several zones by parts
    own = edge_zone.where("zone_idx is not null").groupBy("fips", "edge_id").agg(F.collect_list(F.struct("level", "zone_idx", share.alias("share"))).alias("_in"))
    return net.join(own, ["fips", "edge_id"], "left")


def per_zone(deleted: DataFrame, edge_zone: DataFrame, zones: DataFrame, scope: str = "county", strict: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """level, scope, zone_idx, n_total, n_deleted, n_marooned, km_total, km_lost under each scenario.

    An edge is marooned if it survives but no surviving path leads to its zone's anchor.
    Every zone has a row, those without edges zeros. If edge_zone has ``share``, edges count by it."""
    if scope not in ("county", "zone"):
        raise ValueError("scope is county or zone")
    if labels is None:
        labels = frozen(surviving_labels(deleted) if scope == "county" else zone_labels(deleted, edge_zone, strict))  # met twice
    on = KEYS if scope == "county" else [*KEYS, "level", "zone_idx"]
    home = zones.select("fips", "level", "zone_idx", F.col("anchor_node").alias("node"))
    grid = deleted.select(*KEYS).distinct()
    base = grid.join(home, "fips").join(labels, [*on, "node"], "left").select(*KEYS, "level", "zone_idx", F.col("label").alias("home"))
    zoned = deleted if "_in" in deleted.columns else memberships(deleted, edge_zone)
    counted = zoned.select(*KEYS, "src", "length_m", "deleted", "_in")
    inside = lambda df, *more: df.select(*KEYS, "src", "length_m", "deleted", *more, F.explode("_in").alias("_z")).select(*KEYS, "src", "length_m", "deleted", *more, "_z.*")
    own = labels.select(*on, F.col("node").alias("src"), "label")
    alive = counted.where(~F.col("deleted"))
    alive = inside(alive.join(own, [*on, "src"], "left"), "label") if scope == "county" else inside(alive).join(own, [*on, "src"], "left")
    e = alive.unionByName(inside(counted.where("deleted")).withColumn("label", F.lit(None).cast(dict(labels.dtypes)["label"])))
    share, metres = F.col("share"), F.col("length_m") * F.col("share")
    parts = e.groupBy(*KEYS, "level", "zone_idx", "label", "deleted").agg(F.sum(share).alias("n"), F.sum(metres).alias("m"))
    met = parts.join(base, [*KEYS, "level", "zone_idx"], "left")  # components within zones, instead of edges
    lost = ~F.col("deleted") & ~F.coalesce(F.col("label") == F.col("home"), F.lit(False))
    of = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(F.lit(0)))
    counts = met.withColumn("marooned", lost).groupBy(*KEYS, "level", "zone_idx").agg(
        F.sum("n").alias("n_total"), of(F.col("deleted"), "n").alias("n_deleted"), of(F.col("marooned"), "n").alias("n_marooned"),
        (F.sum("m") / 1000).alias("km_total"), (of(F.col("deleted") | F.col("marooned"), "m") / 1000).alias("km_lost"),
    )
    full = base.drop("home").join(counts, [*KEYS, "level", "zone_idx"], "left").na.fill(0)
    return full.withColumn("scope", F.lit(scope))


def clusters(labels: DataFrame) -> DataFrame:
    """fips, scenario, label, size: surviving components by nodes."""
    return labels.groupBy(*KEYS, "label").agg(F.count("*").alias("size"))


def diagnostics(deleted: DataFrame, labels: DataFrame) -> DataFrame:
    """giant_frac, second_frac, n_components (of nodes with a surviving edge) for each scenario; 0 if nothing survives."""
    sizes = clusters(labels).groupBy(*KEYS, "size").agg(F.count("*").alias("n"))
    w = W.partitionBy(*KEYS).orderBy(F.col("size").desc())
    top = sizes.withColumns({"_i": F.row_number().over(w), "_next": F.when(F.col("n") > 1, F.col("size")).otherwise(F.lead("size").over(w))})
    agg = top.groupBy(*KEYS).agg(F.sum(F.col("size") * F.col("n")).alias("_live"), F.max("size").alias("_one"), F.max(F.when(F.col("_i") == 1, F.col("_next"))).alias("_two"), F.sum("n").alias("n_components"))
    out = deleted.select(*KEYS).distinct().join(agg, KEYS, "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("_live"), F.lit(0.0))
    return out.select(*KEYS, share("_one").alias("giant_frac"), share("_two").alias("second_frac"), F.coalesce("n_components", F.lit(0)).alias("n_components"))


def zone_columns(net: DataFrame, edge_zone: DataFrame, levels: list[str]) -> DataFrame:
    """net with a column z0, z1, ... of zone_idx for each level (null: no zone); an edge has one zone a level."""
    out = net
    for i, level in enumerate(levels):
        out = out.join(edge_zone.where(F.col("level") == level).select("fips", "edge_id", F.col("zone_idx").alias(f"z{i}")), ["fips", "edge_id"], "left")
    return out


def one_pass(deleted: DataFrame, zones: DataFrame, levels: list[str], scopes: tuple[str, ...] = ("county",), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``per_zone`` and ``diagnostics`` give for all levels and scopes, in one task per county and scenario.

    deleted: the network with ``zone_columns``, under each scenario. Edges meet once, by county and scenario: labels,
    marooned edges and cluster sizes are counted over arrays, and only counts leave the task."""
    if not set(scopes) <= {"county", "zone"}:
        raise ValueError("scopes are county and zone")
    kinds = dict(deleted.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in KEYS) + ", level string, scope string, zone_idx int, n_total bigint, n_deleted bigint, n_marooned bigint, km_total double, km_lost double, giant_frac double, second_frac double, n_components bigint"

    def each(key, e, z):
        import numpy as np
        import pandas as pd

        ids, ends = np.unique(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy()]), return_inverse=True)
        src, dst, gone, metres = ends[: len(e)], ends[len(e) :], e["deleted"].to_numpy(bool), e["length_m"].to_numpy(float)

        def labels(of, a, b, n):
            """Labels of n places, -1 where no edge of ``of`` ends."""
            out = np.full(n, -1)
            if of.any():
                place, least = _min_labels(a[of], b[of])
                out[place] = least
            return out

        whole = labels(~gone, src, dst, len(ids)) if "county" in scopes else None
        rows = []
        for i, level in enumerate(levels):
            zone = e[f"z{i}"].to_numpy(float)
            inside = ~np.isnan(zone)
            zone = np.where(inside, zone, 0).astype(np.int64)
            own = z[z["level"] == level]
            if not len(own):
                continue
            known, anchor, has = own["zone_idx"].to_numpy(np.int64), own["anchor_node"].to_numpy(ids.dtype), own["has"].to_numpy(bool)
            n = int(max(known.max(), zone.max(initial=0))) + 1
            at = np.searchsorted(ids, anchor).clip(max=max(len(ids) - 1, 0))
            found = has & (ids[at] == anchor) if len(ids) else np.zeros(len(own), bool)
            home_at = np.full(n, -1)
            home_at[known] = np.where(found, at, -1)
            for scope in scopes:
                if scope == "county":
                    here, home = whole[src], np.where(home_at >= 0, whole[home_at], -1)
                else:
                    label = labels(~gone & (inside if strict else True), zone * len(ids) + src, zone * len(ids) + dst, n * len(ids))
                    here, home = label[zone * len(ids) + src], np.where(home_at >= 0, label[np.arange(n) * len(ids) + home_at], -1)
                lost = ~gone & ~((here == home[zone]) & (here >= 0))
                count = lambda of, zone=zone, inside=inside, n=n: np.bincount(zone[inside & of], minlength=n)[known]
                length = lambda of, zone=zone, inside=inside, n=n: np.bincount(zone[inside & of], metres[inside & of], n)[known]
                every = np.ones(len(e), bool)
                cols = {"zone_idx": known, "n_total": count(every), "n_deleted": count(gone), "n_marooned": count(lost), "km_total": length(every) / 1000, "km_lost": length(gone | lost) / 1000}
                rows.append(pd.DataFrame({"level": level, "scope": scope, **cols}))
        if "county" in scopes:
            size = np.sort(np.bincount(whole[whole >= 0])) if (whole >= 0).any() else np.zeros(0, int)
            size = size[size > 0]
            live = max(int(size.sum()), 1)
            rows.append(pd.DataFrame({"giant_frac": [size[-1] / live if len(size) else 0.0], "second_frac": [size[-2] / live if len(size) > 1 else 0.0], "n_components": [len(size)]}))
        out = pd.concat([r.astype(object) for r in rows], ignore_index=True) if rows else pd.DataFrame({"level": []})  # whole numbers stay whole beside nulls
        names = ["level", "scope", "zone_idx", "n_total", "n_deleted", "n_marooned", "km_total", "km_lost", "giant_frac", "second_frac", "n_components"]
        return out.reindex(columns=names).assign(**dict(zip(KEYS, key, strict=True)))[[*KEYS, *names]].astype(object)

    e = deleted.select(*KEYS, "src", "dst", "length_m", "deleted", *(f"z{i}" for i in range(len(levels))))
    grid = deleted.select(*KEYS).distinct()
    homes = zones.select("fips", "level", "zone_idx", F.coalesce("anchor_node", F.lit(0)).alias("anchor_node"), F.col("anchor_node").isNotNull().alias("has"))  # no null, so that ids stay whole numbers
    z = grid.join(homes, "fips").select(*(F.col(c).alias(c) for c in (*KEYS, "level", "zone_idx", "anchor_node", "has")))
    found = frozen(e.groupBy(*KEYS).cogroup(z.groupBy(*KEYS)).applyInPandas(each, schema))
    counted = found.where("level is not null").select(*KEYS, "level", "zone_idx", "n_total", "n_deleted", "n_marooned", "km_total", "km_lost", "scope")
    return counted, found.where("level is null").select(*KEYS, "giant_frac", "second_frac", "n_components")
