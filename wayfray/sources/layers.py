"""Layers by name and county: addresses, landing, reading; and results, written and read again."""

from __future__ import annotations

import json
import os
import shutil
import urllib.request
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.zoning import select_zone_polygons
from . import shapefile

# The public addresses of the census layers, and how much of the country a file covers.
YEAR = 2025
_ROOT = "https://www2.census.gov/geo/tiger/TIGER{year}"
LAYERS = {
    "edges": ("county", "/EDGES/tl_{year}_{fips}_edges.zip"),
    "roads": ("county", "/ROADS/tl_{year}_{fips}_roads.zip"),
    "block": ("state", "/TABBLOCK20/tl_{year}_{state}_tabblock20.zip"),
    "bg": ("state", "/BG/tl_{year}_{state}_bg.zip"),
    "tract": ("state", "/TRACT/tl_{year}_{state}_tract.zip"),
    "zcta": ("national", "/ZCTA520/tl_{year}_us_zcta520.zip"),
    "county": ("national", "/COUNTY/tl_{year}_us_county.zip"),
}


def build_url(layer: str, fips: str | int | None = None, year: int = YEAR) -> str:
    """The address of a layer's file; KeyError for unknown layers, ValueError without a needed county."""
    if layer not in LAYERS:
        raise KeyError(f"unknown layer {layer!r}; one of {sorted(LAYERS)}")
    covers, path = LAYERS[layer]
    if covers == "national":
        return (_ROOT + path).format(year=year)
    if fips is None:
        raise ValueError(f"layer {layer!r} needs a county")
    code = str(fips).zfill(5)
    return (_ROOT + path).format(year=year, state=code[:2], fips=code)


def fetch(url: str, cache: str | Path) -> Path:
    """The first .shp of a zipped layer, downloaded and unpacked once; both steps appear whole or not at all."""
    cache = Path(cache)
    cache.mkdir(parents=True, exist_ok=True)
    archive = cache / url.rsplit("/", 1)[-1]
    folder = archive.with_suffix("")
    if not archive.exists():
        part = archive.with_name(f"{archive.name}.{uuid.uuid4().hex}.partial")
        try:
            with urllib.request.urlopen(url, timeout=300) as r, part.open("wb") as f:
                shutil.copyfileobj(r, f)
            part.rename(archive)
        finally:
            part.unlink(missing_ok=True)
    if not folder.exists():
        fresh = folder.with_name(f"{folder.name}.{uuid.uuid4().hex}")
        with zipfile.ZipFile(archive) as z:
            z.extractall(fresh)
        os.replace(fresh, folder)
    found = sorted(folder.glob("*.shp"))
    if not found:
        raise FileNotFoundError(f"no .shp in {archive}")
    return found[0]


def load_layer(spark: SparkSession, layer: str, fips: str | None = None, year: int = YEAR, cache: str | Path = "layers", columns: list[str] | None = None, bbox: tuple[float, ...] | None = None) -> DataFrame:
    """A layer with ``geometry``: a line for edges and roads (a row per part), rings for zones. Columns and box go down to the reader."""
    shapefile.register(spark)
    r = spark.read.format("shapefile")
    if columns is not None:
        r = r.option("columns", ",".join(columns))
    if bbox is not None:
        r = r.option("bbox", ",".join(map(str, bbox)))
    df = r.load(str(fetch(build_url(layer, fips, year), cache)))
    if layer not in ("edges", "roads"):
        return df.withColumnRenamed("parts", "geometry")
    lines = df.select("*", F.posexplode("parts").alias("_part", "geometry")).drop("parts")
    return lines.withColumns({"edge_id": edge_id(df.columns), "fips": F.lit(str(fips).zfill(5))}).drop("_part")


def edge_id(columns: list[str]) -> Column:
    """The number of a line of a layer, however its files are split: of the layer's own id, or else of all it holds, and of the part (_part)."""
    if "TLID" in columns:
        return F.expr("cast(TLID as bigint) * 1000 + _part")
    return F.xxhash64(*sorted(c for c in columns if c != "parts"), F.col("geometry"), F.col("_part"))


def load_county_boundary(spark: SparkSession, fips: str, **kw) -> DataFrame:
    code = str(fips).zfill(5)
    one = load_layer(spark, "county", **kw).where(F.col("GEOID") == code)
    if one.isEmpty():
        raise ValueError(f"county {code} is not in the layer")
    return one


def load_zone_polygons(spark: SparkSession, level: str, fips: str, boundary: DataFrame, **kw) -> DataFrame:
    """A level's polygons of a county; the national layer is read within the boundary's box."""
    box = None
    if level == "zcta":
        b = boundary.select(G.bounds(F.col("geometry")).alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).first()
        box = tuple(b)
    return select_zone_polygons(load_layer(spark, level, fips, bbox=box, **kw), level, fips, boundary)


def write_results(tables: dict[str, DataFrame], folder: str, csv: bool = False) -> None:
    """Each table partitioned by county, Parquet or CSV; counties written again replace their own parts only."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fips")
        (w.option("header", True).csv if csv else w.parquet)(f"{folder}/{name}")


def read_results(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of write_results; county codes stay strings. With a schema the files are CSV."""
    if schema:
        return spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}")
    df = spark.read.parquet(f"{folder}/{name}")
    return df.withColumn("fips", F.lpad(F.col("fips").cast("string"), 5, "0"))


def has_results(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def discover_fips(spark: SparkSession, folder: str, name: str = "zones") -> list[str]:
    """Counties with results, sorted; one entry per county."""
    return [r[0] for r in read_results(spark, folder, name).select("fips").distinct().orderBy("fips").collect()]


def write_manifest(spark: SparkSession, folder: str, arguments: dict) -> None:
    """manifest.json in the folder of the results, wherever that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps(arguments, indent=1, default=str).encode()))
    finally:
        out.close()
