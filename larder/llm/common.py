"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset and all tasks run on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = current or tempfile.mkdtemp(prefix="larder-checkpoint-")
        if not current:
            spark.sparkContext.setCheckpointDir(where)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: as cut(), and Spark knows its size, so it broadcasts it only if it is small."""
    where = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Batches of `rows` rows between Spark and its Python workers while a table is made inside: whole texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Gives the memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over the batches of a task, after which the worker gives the memory it no longer uses back to the system.

    Workers go on from stage to stage; without this each keeps the most it ever took.
    """

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def released_groups(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As released(), after each pair of groups: a worker of cogroups has no last call."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = work(left, right)
        give_back()
        return made

    return run


def heaps_back(spark: SparkSession) -> None:
    """Asks the JVM of every executor to collect its garbage and give the heap that it no longer needs back to the system.

    An executor keeps the heap of its fullest step, though little of it is alive between steps; Python workers of the next step then come
    on top. Two tasks for each core, so that every executor gets one; calls at the same time are one collection.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    collected = spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done"))
    collected.write.format("noop").mode("overwrite").save()


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called that, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(rows: DataFrame, key: str, wanted: DataFrame, bound: int | None = None) -> DataFrame:
    """The rows whose `key`, a long of 0 or more, is in the column `row` of wanted.

    The wanted keys become bitmaps of 32,768 keys each, about one bit for each row that one_of_each numbers. They are stored, so
    Spark broadcasts them if their size allows it and else shuffles rows by bitmap; keys below `bound` are always broadcast.
    """
    bucket, bits = fresh("bucket", rows.columns), fresh("bits", rows.columns)
    made = wanted.groupBy(F.shiftright("row", 15).alias(bucket)).agg(F.bitmap_construct_agg(F.col("row").bitwiseAND(F.lit(32767))).alias(bits))
    at = F.col(key).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn(bucket, F.shiftright(key, 15)).join(F.broadcast(made) if bound else stored(made), bucket)
    return joined.where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1).select(rows.columns)


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exactly one row of each group, with all its columns: the one of the smallest doc_id, a null id last.

    groups: makes (row, component) of (row, doc_id, text). Among equal doc_ids, null ones too, any
    one row stays; rows are numbered for this and materialised, so repeated rows are told apart.
    """
    number = fresh("row", docs.columns)
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    named = groups(rows.select(F.col(number).alias("row"), "doc_id", "text"))
    ids = rows.select(F.col(number).alias("row"), "doc_id").join(named, "row")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return only(rows, number, first.select("first.row")).select(docs.columns)


#: Edges of components() that a task gets, about: the partitions of a round follow from their number.
EDGES = 50_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (u, v) with u > v: every node's chosen neighbours point at its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star until the edges no longer change, each
    round checkpointed in as many partitions as its edges need; grouping combines on the map side and Spark's adaptive
    join splits a hot centre. Self loops and repeated edges are ignored; nodes
    without an edge are not returned.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        tasks = 1 + state[0] // EDGES  # as many as the edges need: empty partitions cost a file for each shuffle and round
        large = _stars(edges.coalesce(tasks), True).coalesce(tasks).distinct().coalesce(tasks)
        edges = cut(_stars(large, False).coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().coalesce(tasks)
    )
