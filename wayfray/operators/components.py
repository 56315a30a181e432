"""Connected components of any number of graphs at once.

``keyed_components`` labels a graph in a task; ``star_components`` in rounds of alternating large
and small stars; ``contracted_components`` first merges what each task's own edges connect, so that
only the nodes in which tasks meet are left. ``components`` takes the first for graphs that
fit a task and the last for others."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where it is unset, as in tests, a local master gets one of its own; a cluster is asked to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own[0] is None:
        _own[0] = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


_own: list[str | None] = [None]


def frozen(df: DataFrame) -> DataFrame:
    """df in the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Asks both collectors to let go of plans that nothing names any more, with which the shuffle files of finished steps go.

    For operators of many steps, between them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def star_components(edges: DataFrame, by: list[str] | None = None, src: str = "src", dst: str = "dst", rounds: int = 100, tidy: int = 8) -> DataFrame:
    """by..., node, label: each endpoint of an edge and the least node of its component.

    Large star: a node's larger neighbours move to the least node of its neighbourhood. Small
    star: its smaller neighbours and the node itself do. The number of rounds is about the
    logarithm of the largest component; a hub's rows can be split, as the least neighbour is
    pre-aggregated and joined back. Shuffle files of past rounds go every ``tidy`` rounds."""
    by = by or []
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*by, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = frozen(e.distinct())
    nodes = e.select(*by, F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.where("u <> v")
    last = None
    for k in range(rounds + 1):
        if k == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
        both = e.union(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        moved = large.join(down, [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        e = frozen(moved.union(down.select(*by, "u", F.col("m").alias("v"))).distinct())
        if k % tidy == tidy - 1:
            release(edges.sparkSession)
    roots = e.select(*by, F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(roots, [*by, "node"], "left").select(*by, "node", F.coalesce("label", "node").alias("label"))


#: Edges of a graph that a task may label by itself, and of a run of a larger one.
PER_TASK = 250_000


def contracted_components(edges: DataFrame, by: list[str], chunk: int = PER_TASK) -> DataFrame:
    """by..., node, label for graphs of any size, all graphs at once.

    Edges are dealt by ranges of their graphs and nodes, so that neighbours meet. Each task labels its edges in runs of
    ``chunk``. A node with several of these labels links them; the links, one for a node and further label, are graphs
    again: labelled in a task each if they fit, else contracted in turn while that halves them, else by star rounds."""
    kinds = dict(edges.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + (", " if by else "") + f"node {kinds['src']}, own {kinds['src']}"

    def local(frames):
        import numpy as np
        import pandas as pd

        def labelled(pdf):
            which = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(pdf), np.int64)
            ids, ends = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
            at = which * len(ids)
            place, least = _min_labels(at + ends[: len(pdf)], at + ends[len(pdf) :])  # by graph, then by node: the least place is the least node
            out = pdf.drop_duplicates(by)[by].iloc[place // len(ids)].reset_index(drop=True) if by else pd.DataFrame(index=range(len(place)))
            return out.assign(node=ids[place % len(ids)], own=ids[least % len(ids)])

        held, n = [], 0
        for f in frames:
            while len(f):
                part = f.iloc[: chunk - n]
                held.append(part)
                n, f = n + len(part), f.iloc[len(part) :]
                if n >= chunk:
                    yield labelled(pd.concat(held, ignore_index=True))
                    held, n = [], 0
        if n:
            yield labelled(pd.concat(held, ignore_index=True))

    known = frozen(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*by, "src", "dst"))
    size = known.count()
    runs = min(-(-size // chunk), max(64, -(-size // PER_TASK))) or 1
    dealt = known.repartitionByRange(runs, *by, "src", "dst").sortWithinPartitions(*by, "src", "dst")
    local_labels = frozen(dealt.mapInPandas(local, schema))
    least = local_labels.groupBy(*by, "node").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    shared = frozen(least.where("low <> high").select(*by, "node", "low"))
    links = frozen(local_labels.join(shared, [*by, "node"]).where("own <> low").select(*by, F.col("own").alias("src"), F.col("low").alias("dst")).distinct())
    widest = links.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if widest <= chunk:
        roots = keyed_components(links, by)
    else:
        roots = contracted_components(links, by, chunk) if 2 * links.count() <= size else star_components(links, by)
    roots = frozen(roots.withColumnRenamed("node", "low"))
    return least.join(roots, [*by, "low"], "left").select(*by, "node", F.coalesce("label", "low").alias("label"))


def components(edges: DataFrame, by: list[str], largest: int | None = None, per_task: int = PER_TASK) -> DataFrame:
    """by..., node, label. largest: edges of the largest graph, if known; else they are counted."""
    if largest is None:
        largest = edges.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return keyed_components(edges, by) if largest <= per_task else contracted_components(edges, by)


def _min_labels(src, dst):
    """The least index of each node's component, by hooking and pointer jumping."""
    import numpy as np

    ids, inv = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = inv[: len(src)], inv[len(src) :]
    label = np.arange(len(ids))
    while True:
        a, b = label[s], label[d]
        low = np.minimum(a, b)
        if (a == b).all():
            return ids, ids[label]
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def keyed_components(edges: DataFrame, by: list[str]) -> DataFrame:
    """by..., node, label for many graphs of moderate size, a graph to a task; for one huge graph use star_components."""
    import pandas as pd

    kinds = dict(edges.dtypes)

    def label(key, pdf):
        node, least = _min_labels(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        return pd.DataFrame({**dict.fromkeys(by), "node": node, "label": least}).assign(**dict(zip(by, key, strict=True)))[[*by, "node", "label"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"node {kinds['src']}, label {kinds['src']}"])
    return edges.select(*by, "src", "dst").groupBy(*by).applyInPandas(label, schema)
