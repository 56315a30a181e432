"""Command line: ``python -m wayfray.cli sweep --fips 18097 ...`` and ``python -m wayfray.cli fit --results DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import curves as C
from .operators import network as N
from .operators.deletion import p_grid
from .plans import county as P
from .schemas import PROTOCOLS
from .sources import layers as L

#: The zone table's columns as CSV has them, the county being a folder.
ZONE_SCHEMA = "level string, scope string, protocol string, unit string, p double, zone_id string, n_edges bigint, frag_nominal double, frag_marooned double, frag_effective double, label string, fips string"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wayfray")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sweep", help="deletion sweeps of counties")
    s.add_argument("--fips", nargs="+", required=True)
    s.add_argument("--levels", nargs="*", default=["bg", "tract", "zcta"], choices=["block", "bg", "tract", "zcta"])
    s.add_argument("--pmedian", type=int, nargs="*", default=[5], help="service areas a county, one or more numbers; 0: none")
    s.add_argument("--scopes", nargs="+", default=["county"], choices=["county", "zone"])
    s.add_argument("--protocols", nargs="+", default=["random"], choices=list(PROTOCOLS))
    s.add_argument("--units", nargs="+", default=["edge"], choices=["edge", "road"])
    s.add_argument("--roads", default="drive", choices=["all", "arterial", "drive", "main"])
    s.add_argument("--p-values", type=p_grid, default=None)
    s.add_argument("--replicates", type=int, default=50)
    s.add_argument("--detail-p", type=p_grid, default=[0.20])
    s.add_argument("--year", type=int, default=L.YEAR)
    s.add_argument("--cache", default="layers")
    s.add_argument("--outdir", default="results")
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--per-job", type=int, default=200, help="counties in one Spark job")
    s.add_argument("--csv", action="store_true", help="CSV instead of Parquet")
    s.add_argument("--describe-only", action="store_true")
    s.add_argument("--quiet", action="store_true", help="log errors only")
    f = sub.add_parser("fit", help="power fits of marooned scores")
    f.add_argument("--results", default="results")
    f.add_argument("--fips", nargs="*", help="all with results, if none is named")
    f.add_argument("--all", action="store_true", help="all with results")
    f.add_argument("--csv", action="store_true", help="the results are CSV")
    f.add_argument("--overlay", action="store_true", help="also every county's curve beside its fit, over the normalised rank")
    f.add_argument("--level", default="tract")
    f.add_argument("--scope", default="county")
    f.add_argument("--xaxis", default="rank", choices=["rank", "norm_rank"])
    f.add_argument("--outdir", default=None)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("wayfray").getOrCreate()
    if getattr(a, "quiet", False):
        spark.sparkContext.setLogLevel("ERROR")
    if a.command == "fit":
        zone = L.read_results(spark, a.results, "zones", ZONE_SCHEMA if a.csv else None)
        if a.fips and not a.all:
            zone = zone.where(zone.fips.isin([str(x).zfill(5) for x in a.fips]))
        scored, fits = P.postprocess(zone, a.level, a.scope, a.xaxis)
        if a.outdir:
            tables = {"powerlaw": scored, "powerlaw_summary": fits} | ({"overlay": C.overlay_points(scored, fits)} if a.overlay else {})
            L.write_results(tables, a.outdir)
        P.unfitted(scored, fits).show(100, truncate=False)
        fits.show(100, truncate=False)
        return 0
    if a.describe_only:
        for code in a.fips:
            N.summary(N.build_network(L.load_layer(spark, "edges", code, a.year, a.cache), a.roads, project=True)).show(truncate=False)
        return 0
    kw = {"levels": a.levels, "pmedian": [k for k in a.pmedian if k], "roads": a.roads, "scopes": a.scopes, "protocols": a.protocols, "units": a.units, "p_values": a.p_values, "replicates": a.replicates, "detail": a.detail_p, "seed": a.seed, "year": a.year, "cache": a.cache}
    L.write_manifest(spark, a.outdir, vars(a))
    found = P.run_many(spark, a.fips, a.outdir, per_job=a.per_job, csv=a.csv, **kw)
    found.orderBy("fips", "level").show(100, truncate=False)
    if not a.csv and L.has_results(spark, a.outdir, "summary"):
        summary = L.read_results(spark, a.outdir, "summary").join(found.select("fips").distinct(), "fips", "left_semi")
        summary.select("fips", "level", "scope", "n_zones", "median_frag", "rank_at_50pct", "pc_second_peak", "pc_giant_half").show(100, truncate=False)
    return int(found.where("outcome <> 'failed'").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
