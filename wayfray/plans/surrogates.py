"""Road-like layers derived from the customer table: a square lattice of customers, pruned by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import md5_bits
from ..operators.components import frozen
from ..operators.network import build_network
from ..operators.zoning import all_levels, assign_by_polygons, number_zones

FIPS = "00000"
SPACING = 100.0
PRUNED = int(0.15 * 2**52)
CLASSES = {"AUTOMOBILE": "S1100", "BUILDING": "S1200", "FURNITURE": "S1400", "HOUSEHOLD": "S1630", "MACHINERY": "S1730"}
LEVELS = {"coarse": 4, "medium": 8}


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edges(n: DataFrame) -> DataFrame:
    """The raw layer of links (fips, f, t, from, to: places in the lattice; along: whether a row's; w, c_acctbal, c_mktsegment)."""
    e = n.withColumn("edge_id", F.col("f") * 100000 + F.col("t"))
    e = e.where(md5_bits(F.concat(F.lit("prune|"), F.col("edge_id").cast("string"))) >= PRUNED)
    classes = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    at = lambda k: _point(F.expr(f"{k} % w") * SPACING, F.expr(f"{k} div w") * SPACING)
    street = F.when(F.col("along"), F.concat(F.lit("row "), F.expr("cast(from div w as string)"))).otherwise(F.concat(F.lit("column "), F.expr("cast(from % w as string)")))
    return e.select(
        "edge_id", "fips", F.col("f").alias("TNIDF"), F.col("t").alias("TNIDT"), F.when(F.col("c_acctbal") < 0, "N").otherwise("Y").alias("ROADFLG"),
        classes[F.col("c_mktsegment")].alias("MTFCC"), street.alias("LINEARID"), F.array(at("from"), at("to")).alias("geometry"), "w",
    )


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw edge layer of all customers, the last row being ragged: edge_id, fips, TNIDF, TNIDT, ROADFLG, MTFCC, LINEARID, geometry; w is the lattice's side."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("f"), "c_acctbal", "c_mktsegment")
    side = c.agg(F.floor(F.sqrt(F.count("*"))).cast("bigint").alias("w"), F.count("*").alias("n"))
    n = c.repartition(spark.sparkContext.defaultParallelism, "f").crossJoin(F.broadcast(side)).withColumn("from", F.col("f"))  # side is one row
    to = F.explode(F.array(F.when((F.expr("f % w") + 1 < F.col("w")) & (F.col("f") + 1 < F.col("n")), F.col("f") + 1), F.when(F.col("f") + F.col("w") < F.col("n"), F.col("f") + F.col("w"))))
    e = n.withColumn("t", to).where("t is not null").withColumns({"to": F.col("t"), "along": F.col("t") == F.col("f") + 1, "fips": F.lit(FIPS)})
    return _edges(e)


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice for each nation, of its customers in the order of their keys; in every ninth nation all roads are private."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", F.col("c_custkey").alias("f"), "c_acctbal", "c_mktsegment")
    own = W.partitionBy("c_nationkey")
    n = c.withColumns({"from": (F.row_number().over(own.orderBy("f")) - 1).cast("bigint"), "w": F.ceil(F.sqrt(F.count("*").over(own))).cast("bigint")})
    to = F.explode(F.array(F.when(F.expr("from % w") + 1 < F.col("w"), F.col("from") + 1), F.col("from") + F.col("w")))
    far = n.select("c_nationkey", F.col("from").alias("to"), F.col("f").alias("t"))
    e = n.withColumn("to", to).where("to is not null").join(far, ["c_nationkey", "to"]).withColumns({"along": F.col("to") == F.col("from") + 1, "fips": _code("c_nationkey")})
    raw = _edges(e.where("w > 1"))
    return raw.withColumn("MTFCC", F.when(F.col("fips").cast("int") % 9 == 4, "S1740").otherwise(F.col("MTFCC")))


def _code(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 5, "0")


def county_zones(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """fips, GEOID, geometry: n by n squares over each nation's lattice, but for every seventh nation, whose layer is missing."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg((F.ceil(F.sqrt(F.count("*"))) * SPACING / n).alias("s"))
    cells = c.where("c_nationkey % 7 <> 5").withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return cells.select(_code("c_nationkey").alias("fips"), F.format_string("K%04d", F.col("id")).alias("GEOID"), _squares(n).alias("geometry"))


def _squares(n: int) -> Column:
    """The ring of the cell ``id`` of side s, row by row."""
    r, c = F.expr(f"id div {n}"), F.expr(f"id % {n}")
    x0, y0, x1, y1 = c * F.col("s"), r * F.col("s"), (c + 1) * F.col("s"), (r + 1) * F.col("s")
    return F.array(F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0)))


def messy(raw: DataFrame) -> DataFrame:
    """The layer with some node ids that are no numbers and some self-loops."""
    return raw.withColumns({
        "TNIDT": F.when(F.col("edge_id") % 11 == 0, F.col("TNIDF")).otherwise(F.col("TNIDT")),
        "TNIDF": F.when(F.col("edge_id") % 13 == 0, F.concat(F.lit("x"), F.col("TNIDF").cast("string"))).otherwise(F.col("TNIDF").cast("string")),
    })


def network(spark: SparkSession, sf_dir: str, roads: str = "drive", giant_only: bool = True) -> DataFrame:
    return frozen(build_network(lattice(spark, sf_dir), roads, giant_only=giant_only, check_empty=False))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fips, id, x, y, s_acctbal: suppliers as points beside the lattice's nodes."""
    side = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.floor(F.sqrt(F.count("*"))).cast("bigint").alias("w"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").crossJoin(F.broadcast(side))  # side is one row
    return s.select(F.lit(FIPS).alias("fips"), F.col("s_suppkey").alias("id"), (F.expr("s_suppkey * 37 % w") * SPACING + 30).alias("x"), (F.expr("s_suppkey * 53 % w") * SPACING - 20).alias("y"), "s_acctbal")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of some standing."""
    return supplier_points(spark, sf_dir).where("s_acctbal > 5000")


def zone_grid(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Square zones over the lattice's extent, numbered row by row."""
    n = LEVELS[level]
    side = spark.read.parquet(f"{sf_dir}/customer.parquet").agg((F.floor(F.sqrt(F.count("*"))) * SPACING / n).alias("s"))
    cells = spark.range(n * n).crossJoin(F.broadcast(side))  # side is one row
    return number_zones(cells.select(F.format_string("K%04d", F.col("id")).alias("GEOID"), _squares(n).alias("geometry")), level, FIPS)


def sides(net: DataFrame) -> DataFrame:
    """fips, edge_id, left, right: postal areas of four blocks' width on the two sides of each edge, none west of the map."""
    along = F.col("y0") == F.col("y1")
    def area(sign: int) -> Column:
        x, y = F.col("mid_x") + F.when(along, 0).otherwise(sign), F.col("mid_y") + F.when(along, sign).otherwise(0)
        return F.when((x >= 0) & (y >= 0), F.concat(F.lit("area "), F.floor(y / (4 * SPACING)).cast("string"), F.lit("/"), F.floor(x / (4 * SPACING)).cast("string")))

    return net.select("fips", "edge_id", area(-1).alias("left"), area(1).alias("right"))


def diamonds(spark: SparkSession, sf_dir: str, radius: float = 170.0) -> DataFrame:
    """id, geometry: squares on their corner around suppliers."""
    p = supplier_points(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    return p.select("id", F.array(F.array(_point(x - radius, y), _point(x, y - radius), _point(x + radius, y), _point(x, y + radius), _point(x - radius, y))).alias("geometry"))


def assigned(spark: SparkSession, sf_dir: str, net: DataFrame, levels=("coarse", "medium"), drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    ez, zs = all_levels([assign_by_polygons(net, zone_grid(spark, sf_dir, v), cell=SPACING * 4, drop_empty=drop_empty) for v in levels])
    return frozen(ez), frozen(zs)
