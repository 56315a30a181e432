"""A corpus from raw documents to packed sequences, stage by stage, each written and read again.

Defined cases, as each stage's operator defines them: null and empty texts pass toxicity, line dedup and near dedup (they
have nothing in common), take no words of the mix and become one token; repeated rows are copies, of which near dedup keeps
one; an empty table gives an empty result; columns beside the named ones are carried along, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfray.llm import lines, mixing, near_dup, packing, toxicity
from wayfray.llm.common import table
from wayfray.llm.queries import tokenizer_path
from wayfray.operators.components import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has them; every document stays."""
    return lines.drop_recurring_lines(docs, counts=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return near_dup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight, epochs repeated."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Model scores and tokens are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet where all executors can read it, and removed when the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            spent = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            spent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spent, True)
    return docs
