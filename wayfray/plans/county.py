"""Whole experiments: a county from its layers to summary tables, and batches of counties."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import network as N
from ..operators import sweep as S
from ..operators import zoning as Z
from ..operators.components import frozen
from ..operators.deletion import scenarios
from ..sources import layers as L

log = logging.getLogger(__name__)
DEFAULT_P = [round(0.01 * k, 2) for k in range(1, 51)]


def run_batch(raw: DataFrame, polygons: dict[str, DataFrame], codes: DataFrame | None = None, done: DataFrame | None = None, pmedian=(5,), roads: str = "drive", scopes=("county", "zone"), protocols=("random",), units=("edge",), p_values=None, replicates: int = 50, detail=(0.20,), seed: int = 0, project: bool = False, cell: float = 2000.0, strict: bool = False) -> dict[str, DataFrame]:
    """global, zones, curves, summary and outcomes of any number of counties, as one job.

    raw and each level's polygons have ``fips``; codes (fips) are the counties asked for, all of raw's by default;
    done (fips) are skipped. A county that can't be done costs only itself: ``outcomes`` says for every county and
    level what became of it, as ``outcome`` (done, skipped, failed) and ``reason``."""
    spark = raw.sparkSession
    codes = raw.select("fips").distinct() if codes is None else codes.select("fips").distinct()
    codes = frozen(codes.withColumn("skip", F.lit(False)) if done is None else codes.join(done.select("fips").distinct().withColumn("_d", F.lit(True)), "fips", "left").select("fips", F.col("_d").isNotNull().alias("skip")))
    todo = codes.where("not skip").select("fips")
    own = lambda df: df.join(todo, "fips", "left_semi")
    raw = own(raw)
    net = frozen(N.build_network(raw, roads, project=project, check_empty=False))
    parts = [Z.assign_by_polygons(net, Z.number_zones(own(p).withColumn("geometry", _projected(project)), level), cell) for level, p in polygons.items()]
    parts += [Z.assign_by_pmedian(net, k, seed) for k in pmedian]
    ez, zs = (frozen(x) for x in Z.all_levels(parts))
    sc = scenarios(spark, list(p_values or DEFAULT_P), replicates, protocols, units, seed)
    glob, zone = S.sweep(net, ez, zs, sc, scopes, detail, strict)
    zone = frozen(zone)
    curves = C.rank_curves(zone, detail[0]) if detail else C.rank_curves(zone.where("false"))
    out = {"global": glob, "zones": zone, "curves": curves, "summary": C.county_summary(curves, glob, N.summary(net))}
    return out | {"outcomes": outcomes(codes, raw, net, zs, zone, [*polygons, *(f"pmedian{k}" for k in pmedian)])}


def outcomes(codes: DataFrame, raw: DataFrame, net: DataFrame, zones: DataFrame, zone: DataFrame, levels: list[str]) -> DataFrame:
    """fips, level, outcome, reason, n_edges, n_zones, n_scored (zones with a positive score, if two or more)."""
    grid = codes.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    n_raw = raw.groupBy("fips").agg(F.count("*").alias("n_raw"))
    n_net = net.groupBy("fips").agg(F.count("*").alias("n_edges"))
    n_zones = zones.groupBy("fips", "level").agg(F.count("*").alias("n_zones"))
    fits = C.power_fit(C.scored(zone.where("scope = 'county'")), ["fips", "level"]).select("fips", "level", F.lit(True).alias("fitted"))
    all_ = grid.join(n_raw, "fips", "left").join(n_net, "fips", "left").join(n_zones, ["fips", "level"], "left").join(fits, ["fips", "level"], "left").na.fill(0, ["n_raw", "n_edges", "n_zones"])
    reason = (
        F.when(F.col("skip"), "done before").when(F.col("n_raw") == 0, "no edge layer").when(F.col("n_edges") == 0, "no road of the set")
        .when(F.col("n_zones") == 0, "no zone with enough edges").when(F.col("fitted").isNull(), "too few points for a fit")
    )
    failed = (F.col("n_raw") == 0) | (F.col("n_edges") == 0) | (F.col("n_zones") == 0)
    outcome = F.when(F.col("skip"), "skipped").when(failed, "failed").otherwise("done")
    return all_.select("fips", "level", outcome.alias("outcome"), reason.alias("reason"), "n_edges", "n_zones")


def run_layers(raw: DataFrame, polygons: dict[str, DataFrame], fips: str, **kw) -> dict[str, DataFrame]:
    """The same of one county whose layers are given without ``fips``."""
    code = F.lit(fips)
    return run_batch(raw.withColumn("fips", code), {level: p.withColumn("fips", code) for level, p in polygons.items()}, **kw)


def _projected(project: bool):
    from ..functions.geometry import project_rings

    return project_rings(F.col("geometry")) if project else F.col("geometry")


def load_county(spark: SparkSession, code: str, levels=("bg", "tract", "zcta"), year: int = L.YEAR, cache: str = "layers", layer: str = "edges") -> tuple[DataFrame, dict[str, DataFrame]]:
    """A county's edges and its polygons by level, from the public layers, with ``fips``."""
    boundary = L.load_county_boundary(spark, code, year=year, cache=cache)
    polygons = {v: L.load_zone_polygons(spark, v, code, boundary, year=year, cache=cache).withColumn("fips", F.lit(code)) for v in levels}
    return L.load_layer(spark, layer, code, year, cache), polygons


def run_county(spark: SparkSession, fips: str, outdir: str | None = None, load: Callable[..., tuple] = load_county, levels=("bg", "tract", "zcta"), year: int = L.YEAR, cache: str = "layers", layer: str = "edges", **kw) -> dict[str, DataFrame]:
    """One county from the public layers, written if ``outdir`` is given."""
    raw, polygons = load(spark, str(fips).zfill(5), levels=levels, year=year, cache=cache, layer=layer)
    out = run_batch(raw, polygons, **{"project": True, **kw})
    if outdir:
        L.write_results(out, outdir)
    return out


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_many(spark: SparkSession, fips: Iterable[str], outdir: str, skip_existing: bool = True, load: Callable[..., tuple] = load_county, per_job: int = 200, csv: bool = False, levels=("bg", "tract", "zcta"), year: int = L.YEAR, cache: str = "layers", layer: str = "edges", **kw) -> DataFrame:
    """Outcomes of many counties, up to ``per_job`` of them a job; their tables are written below ``outdir``.

    Counties that are done with the same settings are skipped. One whose layers can't be read is an outcome; so is
    one with which a job fails: then the job's counties are run one by one."""
    reading = {"levels": levels, "year": year, "cache": cache, "layer": layer}
    mark = hashlib.md5(json.dumps([reading, kw], sort_keys=True, default=str).encode()).hexdigest()[:12]
    asked = sorted({str(f).zfill(5) for f in fips})
    done = set()
    if skip_existing and L.has_results(spark, outdir, "done"):
        done = {r[0] for r in L.read_results(spark, outdir, "done").where(F.col("settings") == mark).select("fips").collect()} & set(asked)  # counties asked for
    found = [(c, "", "skipped", "done before") for c in sorted(done)]
    todo = [c for c in asked if c not in done]
    for at in range(0, len(todo), per_job):
        layers = {}
        for code in todo[at : at + per_job]:
            try:
                layers[code] = load(spark, code, **reading)
            except (OSError, ValueError, KeyError) as e:
                log.error("county %s: %s", code, e)
                found.append((code, "", "failed", f"layers: {e}"[:200]))
        for group in _jobs(layers, lambda part: _run_group(spark, part, outdir, csv, mark, kw)):
            found += group
    schema = "fips string, level string, outcome string, reason string"
    return spark.createDataFrame(found, schema)  # a row or a few for each county asked for


def _jobs(layers: dict[str, tuple], run: Callable[[dict[str, tuple]], list[tuple]]) -> Iterable[list[tuple]]:
    """The outcomes of all counties together or, if that fails, of one after the other."""
    if not layers:
        return
    try:
        yield run(layers)
    except Exception as e:  # noqa: BLE001  whatever a county's data makes Spark raise
        if len(layers) == 1:
            log.error("county %s: %s", next(iter(layers)), e)
            yield [(next(iter(layers)), "", "failed", f"{type(e).__name__}: {e}"[:200])]
            return
        for code, one in layers.items():
            yield from _jobs({code: one}, run)


def _run_group(spark: SparkSession, layers: dict[str, tuple], outdir: str, csv: bool, mark: str, kw: dict) -> list[tuple]:
    levels = next(iter(layers.values()))[1].keys()
    raw = _together([raw for raw, _ in layers.values()])
    out = run_batch(raw, {v: _together([p[v] for _, p in layers.values()]) for v in levels}, spark.createDataFrame([(c,) for c in layers], "fips string"), **{"project": True, **kw})
    rows = [tuple(r) for r in out["outcomes"].select("fips", "level", "outcome", "reason").collect()]
    L.write_results(out, outdir, csv)
    good = sorted({r[0] for r in rows if r[2] == "done"})
    if good:
        L.write_results({"done": spark.createDataFrame([(c, mark) for c in good], "fips string, settings string")}, outdir)
    return rows


def postprocess(zone: DataFrame, level: str = "tract", scope: str = "county", x: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Scored zones and their power fits over rank or norm_rank, a row per county; counties of fewer than two positive scores have no fit."""
    s = C.scored(zone, level, scope)
    return s, C.overlay(C.power_fit(s, ["fips"], x))


def unfitted(scores: DataFrame, fits: DataFrame) -> DataFrame:
    """fips, n_zones, reason of the counties without a fit."""
    n = scores.groupBy("fips").agg(F.count("*").alias("n_zones"), F.count_if(F.col("score") > 0).alias("_k"))
    return n.join(fits, "fips", "left_anti").select("fips", "n_zones", F.concat(F.lit("positive scores: "), F.col("_k").cast("string"), F.lit("; a fit takes two")).alias("reason"))
