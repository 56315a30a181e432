"""Which edges a scenario deletes. Draws are hashes of (seed, p, replicate, key): the same
mask serves every level and scope, and any task can make its part of it again.

Protocols: random; fitness, by weights 1 - fitness, fitness being the network's column of that name
where it has one and else its class's; betweenness, a targeted attack on the edges of most shortest
paths. Exactly rint(p M) edges go: the k of least key. In a county of many edges the k-th key is found
by counts of key prefixes, narrowed until few edges share one, instead of by sorting the county."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import md5_bits
from ..schemas import DEFAULT_FITNESS, FITNESS, PROTOCOLS, SCENARIO
from .betweenness import edge_betweenness
from .components import frozen

#: Edges of a county that a window may sort for a scenario; bits of a key that one round of counts narrows.
SORTED, NARROWED = 20_000, 12
#: Rows of thresholds that are broadcast; more are joined by shuffles.
BROADCAST_ROWS = 100_000


def scenarios(spark: SparkSession, p_values: list[float], replicates: int, protocols=("random",), units=("edge",), seed: int = 0, salt: str = "") -> DataFrame:
    """A row per protocol, unit, p and replicate."""
    for p in p_values:
        if not 0 <= p <= 1:
            raise ValueError(f"p = {p} is no fraction")
    if not set(protocols) <= set(PROTOCOLS) or not set(units) <= {"edge", "road"}:
        raise ValueError(f"protocols are {', '.join(PROTOCOLS)}, units edge and road")
    rows = [(pr, u, float(p), int(round(p * 1000)), r, f"{seed}|{int(round(p * 1000))}|{r}{salt}") for pr in protocols for u in units for p in p_values for r in range(replicates)]
    return spark.createDataFrame(rows, "protocol string, unit string, p double, p_milli int, replicate int, draw string")


def p_grid(text: str) -> list[float]:
    """'lo:hi:step' or a comma list."""
    if ":" in text:
        lo, hi, step = (round(float(v) * 10_000) for v in text.split(":"))
        return [v / 10_000 for v in range(lo, hi + step // 2 + 1, step)]
    return [float(v) for v in text.split(",")]


def fitness(mtfcc: Column, table: dict[str, float] | None = None) -> Column:
    table = FITNESS if table is None else table
    if not table:
        return F.lit(DEFAULT_FITNESS)
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[mtfcc], F.lit(DEFAULT_FITNESS))


def draw_key(*parts: Column) -> Column:
    return md5_bits(F.concat_ws("|", *[p.cast("string") for p in parts]))


def weighted_key(bits: Column, weight: Column) -> Column:
    """Exponential draw over the weight: the k smallest are a weighted sample without replacement."""
    u = (bits.cast("double") + 0.5) / F.lit(float(2**52))
    return -F.ln(u) / F.greatest(weight, F.lit(1e-12))


def _unfit(net: DataFrame, table: dict[str, float] | None) -> Column:
    own = fitness(F.col("mtfcc"), table)
    return 1 - (F.coalesce(F.col("fitness"), own) if "fitness" in net.columns else own)


def _dealt(net: DataFrame, sc: DataFrame, table: dict[str, float] | None) -> DataFrame:
    """The edges under each scenario, with _w (weight), _score (0 if not given), _target, _m, and the county's mean weight and largest score."""
    e = net.withColumns({"_w": _unfit(net, table), "_score": F.round("betweenness", 6) if "betweenness" in net.columns else F.lit(0.0)})
    size = e.groupBy("fips").agg(F.count("*").alias("_m"), F.avg("_w").alias("_mean"), F.max("_score").alias("_top"))
    cores = net.sparkSession.sparkContext.defaultParallelism
    spread = e.join(size, "fips").repartition(cores, "fips", "edge_id")  # before each row becomes one for each scenario
    return spread.crossJoin(F.broadcast(sc)).withColumn("_target", F.rint(F.col("p") * F.col("_m")))  # the grid is a list of the caller's


def _key(bits: Column, weight: str, score: str) -> Column:
    """What a scenario orders edges or roads by."""
    return F.when(F.col("protocol") == "fitness", weighted_key(bits, F.col(weight))).when(F.col("protocol") == "betweenness", -F.col(score)).otherwise(bits.cast("double"))


def _place() -> Column:
    """_key as a whole number under 2 ** 52, rising with it and spread evenly."""
    share = (
        F.when(F.col("protocol") == "fitness", 1 - F.exp(-F.col("_key") * F.greatest("_mean", F.lit(1e-12))))
        .when(F.col("protocol") == "betweenness", (F.col("_top") + F.col("_key")) / (F.col("_top") + 1)).otherwise(F.col("_key") / F.lit(float(2**52)))
    )
    return F.least(F.floor(share * F.lit(float(2**52))), F.lit(2**52 - 1)).cast("bigint")


def _with(df: DataFrame, thresholds: DataFrame, rows: int) -> DataFrame:
    """df joined with thresholds of its county and scenario."""
    return df.join(F.broadcast(thresholds) if rows <= BROADCAST_ROWS else thresholds, ["fips", *SCENARIO])


def _thresholds(d: DataFrame, most: int) -> tuple[DataFrame, int]:
    """fips, scenario, _last (the key and id of the last edge to go), and how many rows. d: fips, scenario, edge_id, _key, _at, _target (above 0).

    Rounds of counts by key prefix, each finding the prefix that holds the k-th edge and how many of it are
    to go; when few edges share it they are sorted."""
    keys = ["fips", *SCENARIO]
    bits, inside = 0, d.withColumn("_rest", F.col("_target").cast("bigint"))
    while True:
        bits += NARROWED
        n = inside.groupBy(*keys, "_rest", F.shiftright("_at", 52 - bits).alias("_prefix")).agg(F.count("*").alias("_n"))
        run = F.sum("_n").over(W.partitionBy(*keys).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0))
        found = n.withColumn("_run", run).where((F.col("_run") >= F.col("_rest")) & (F.col("_run") - F.col("_n") < F.col("_rest")))
        found = frozen(found.select(*keys, "_prefix", "_n", (F.col("_rest") - F.col("_run") + F.col("_n")).alias("_rest")))
        rows, widest = found.agg(F.count("*"), F.max("_n")).first()
        inside = _with(d, found.select(*keys, "_prefix", "_rest"), rows).where(F.shiftright("_at", 52 - bits) == F.col("_prefix")).drop("_prefix")
        if (widest or 0) <= most or bits + NARROWED > 52:
            break
    order = F.row_number().over(W.partitionBy(*keys).orderBy("_key", "edge_id"))
    last = inside.withColumn("_i", order).where(F.col("_i") == F.col("_rest"))
    return frozen(last.select(*keys, F.struct("_key", "edge_id").alias("_last"))), rows


def delete_edges(net: DataFrame, sc: DataFrame, table: dict[str, float] | None = None, most: int = SORTED) -> DataFrame:
    """Unit edge: exactly rint(p M) edges of each county, those of the least keys; of counties of more than ``most`` edges none is sorted."""
    d = _dealt(net, sc.where("unit = 'edge'"), table)
    d = d.withColumn("_key", _key(draw_key(F.col("draw"), F.col("edge_id")), "_w", "_score"))
    drop = ("_w", "_m", "_target", "draw", "_key", "_score", "_mean", "_top")
    largest = net.groupBy("fips").count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        rank = F.row_number().over(W.partitionBy("fips", *SCENARIO).orderBy("_key", "edge_id"))
        return d.withColumn("deleted", rank <= F.col("_target")).drop(*drop)
    slim = d.where("_target > 0").select("fips", *SCENARIO, "edge_id", "_key", _place().alias("_at"), "_target")
    last, rows = _thresholds(slim, most)
    known = d.join(F.broadcast(last) if rows <= BROADCAST_ROWS else last, ["fips", *SCENARIO], "left")
    return known.withColumn("deleted", F.coalesce(F.struct("_key", "edge_id") <= F.col("_last"), F.lit(False))).drop(*drop, "_last")


def delete_roads(net: DataFrame, sc: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """Unit road: whole roads in drawn order while their edges stay within rint(p M); the first road always, if anything is to go."""
    d = _dealt(net, sc.where("unit = 'road'"), table)
    keys = ["fips", *SCENARIO]
    roads = d.groupBy(*keys, "draw", "road_key", "_target").agg(F.count("*").alias("_n"), F.avg("_w").alias("_gw"), F.avg("_score").alias("_gs"))
    key = _key(draw_key(F.col("draw"), F.lit("road"), F.col("road_key")), "_gw", "_gs")
    w = W.partitionBy(*keys).orderBy("_key", "road_key")
    chosen = roads.withColumn("_key", key).withColumns({"_run": F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)), "_i": F.row_number().over(w)})
    chosen = chosen.select(*keys, "road_key", ((F.col("_target") > 0) & ((F.col("_run") <= F.col("_target")) | (F.col("_i") == 1))).alias("deleted"))
    return d.join(chosen, [*keys, "road_key"]).select(*net.columns, *SCENARIO, "deleted")


def deletions(net: DataFrame, sc: DataFrame, table: dict[str, float] | None = None, n_sources: int = 64) -> DataFrame:
    """The network's edges under every scenario, with ``deleted``. For the protocol betweenness the network's column
    of that name is taken, or else made from ``n_sources`` sources a county."""
    columns = net.columns
    if "betweenness" not in columns and not sc.where("protocol = 'betweenness'").isEmpty():
        net = frozen(net.join(edge_betweenness(net, n_sources), ["fips", "edge_id"]))
    return delete_edges(net, sc, table).select(*columns, *SCENARIO, "deleted").unionByName(delete_roads(net, sc, table).select(*columns, *SCENARIO, "deleted"))
