"""Preparation of a training corpus: quality, near-duplicates, repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept
and returns the columns of documents; the last returns the packed pieces. Every
stage is written to the shared folder and read again before the next, and begins with
heaps that hold nothing of the stage before.

Nulls in any column pass through. A null or empty text is scored as the empty text; if it stays, one
document without words stays of all (they have one fingerprint), loses no repeats, has size 0 in the mixing, which leaves
it out or takes it once, and is packed as its closing id. Of repeated rows and equal texts one stays, of the smallest doc_id,
a null one last. Texts are read whole, however long. Further columns, whatever their names, come through to the
mixing. An empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import mixing, packing, pulearn, simhash, suffix, triejoin
from larder.llm.common import cut, heaps_back, one_of_each, only, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below 0.3."""
    heaps_back(spark)
    return pulearn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    Groups are linked by SimHash fingerprints of five-word shingles within 4 bits, found by multi-index hashing. Fingerprints that far
    apart miss most pairs of a similarity near 0.8, so the one that stays of each group is then joined with the others by tries of those
    shingles, which are exact: no two documents that stay have a similarity of 4/5 or more.
    """

    def groups(rows: DataFrame) -> DataFrame:
        first = cut(simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=5).select(F.col("doc_id").alias("row"), F.col("component_id").alias("c")))
        left = only(rows, "row", first.where("row = c"))
        heaps_back(spark)
        second = triejoin.join(left.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("c"), F.col("component_id").alias("component"))
        return first.join(second, "c").select("row", "component")

    heaps_back(spark)
    return one_of_each(docs, groups)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every byte of a passage of 100 bytes that occurs earlier; n_chars follows the text."""
    heaps_back(spark)
    kind = docs.schema["n_chars"].dataType
    # half the usual shard: a worker holds arrays of several times a shard, and the executors come from other stages
    return suffix.remove_repeats(docs, digests=False, shard_bytes=suffix.SHARD_BYTES // 2).withColumn("n_chars", F.char_length("text").cast(kind))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that the sources come near their target weights."""
    heaps_back(spark)
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    heaps_back(spark)
    # Spark hands tasks to its idle workers in turn: kept words would lie in every worker that any stage began
    return packing.pack(docs, words=200_000)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixed), ("packing", packed),
]
#: No stage but the mixing can be said in SQL; tests hold near copies, repeats and packing against brute force, and each stage's use of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
