"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; ``run`` writes each
result as Parquet into the shared folder and reads it again as the next stage's documents.
All stages but the last return the columns of documents, whatever other columns there are and
whatever their names; the last adds the shard.  An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barcraft.llm import decontaminate, mixing, near_dedup, quality, sharding
from barcraft.llm.scratch import Scratch
from barcraft.session import share_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the repetition rules reject go: null, empty and wordless texts
    and those of fewer than 20 words among them.  Rows are judged each on its own, so repeated
    rows and null ids share their text's verdict; a measure that equals its limit passes; a
    text of any length is measured whole."""
    share_package(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the least doc_id (of rows that share it
    the one whose text is first by hash).  Links are pairs with a similarity of 0.8 or more; 30
    bands miss one at that threshold with probability (1 - 0.8**5)**30 = 7e-6.  Rows with a null
    doc_id and texts without words are in no group and stay."""
    share_package(spark)
    return near_dedup.keep_one_of_each(docs, threshold=80, bands=30)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.  Texts without words stay; repeated
    rows and null ids stand each for themselves; items without words have no windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times; copies are
    equal rows.  A null source is a source.  Texts without words have no size: they go along
    with each whole pass over their source.  Repeated rows are documents of their own, but
    those equal in id and text are taken or left together."""
    return mixing.mixed_copies(docs)


def hash_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row, once, with the shard that it belongs to (column ``shard``, or ``shard_`` where
    there is one).  Rows of one id, copies among them, share a shard until it is full and then go on to
    overflow pages; null ids are one key; a null text has no bytes; a text that is larger than
    a shard has a page of its own."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", hash_sharding),
]

#: SQL has no counterpart of the flow that mixes sources; tests hold every stage's rows against brute force on its own input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    share_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        scratch.keep_only(name)
    return docs
