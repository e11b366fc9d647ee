"""Price refresh as keyed state: what each attempt to fetch a SKU does to the last known price of an item in a store.

Two states, one value a key. By run and store: after a store has blocked an attempt, all later ones of the run fail without being made.
By store and item: an offer replaces the known price unless it is a jump, an implausible price or another product; a miss
keeps the known price, or clears it in the stores that say so. Both are tables that every micro-batch reads and writes: blocks meet
attempts in a join, prices in a fold over partitions sorted by key, so neither many keys nor a hot one costs more than its rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A price that grows or falls by this factor is a mistake; fixed value (see functions.units.price_jump_too_big).
JUMP = 4.0
ATTEMPT = "run string, store string, item long, seq long, sku string, outcome string, price double, impostor string, locked boolean, message string"
RESULT = "run string, store string, item long, seq long, status string, reason string, previous double, price double"
#: The states: the first block of a run in a store, the known price of an item in a store.
BLOCKED = "run string, store string, seq long, message string"
KNOWN = "store string, item long, price double"
Attempt = namedtuple("Attempt", [c.split()[0] for c in ATTEMPT.split(", ")] + ["blocked_by", "attempt"])
FOLDED = f"attempt boolean, {RESULT}"


def jumps(before: float | None, now: float) -> bool:
    return before is not None and before > 0 and now > 0 and max(before, now) / min(before, now) >= JUMP


def decided(r, previous: float | None) -> tuple[str, str | None, float | None]:
    """(status, reason, previous price) of one attempt, by the first rule that applies."""
    text = lambda x: x if isinstance(x, str) and x else None
    offered = r.price is not None and r.price == r.price
    if text(r.sku) is None:
        return "skipped", "no_sku", previous
    if text(r.blocked_by):
        return "failed", r.blocked_by, previous
    if r.outcome in ("blocked", "error"):
        return "failed", text(r.message) or r.outcome, previous
    if r.outcome != "offer" or not offered:
        return "failed", "not_found", previous
    if jumps(previous, r.price):
        return "failed", "price_jump", previous
    if r.price <= 0:
        return "failed", "rejected", previous
    if text(r.impostor) and not bool(r.locked):
        return "failed", r.impostor, previous
    return "updated", None, previous


def first_blocks(attempts: DataFrame, blocked: DataFrame) -> DataFrame:
    """BLOCKED after some attempts: of each run and store the first attempt with a SKU that the store blocked."""
    hits = attempts.where("outcome = 'blocked' and sku is not null and seq is not null").select(blocked.columns)
    return hits.unionByName(blocked).groupBy("run", "store").agg(F.min(F.struct("seq", "message")).alias("first")).select("run", "store", "first.*")


def _folded(batches: Iterator[pa.RecordBatch], clearing: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """FOLDED of rows sorted by key, a known price before the attempts of its key; the price that a key ends with follows them."""
    key, price = None, None
    names = [c.split()[0] for c in FOLDED.split(", ")]
    types = [{"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in FOLDED.split(", ")]

    def ended() -> list[tuple]:
        return [] if price is None else [(False, None, *key, None, None, None, None, price)]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        out = []
        for r in map(Attempt._make, zip(*(batch.column(c).to_pylist() for c in Attempt._fields))):
            if key != (r.store, r.item):
                out += ended()
                key, price = (r.store, r.item), None
            if not r.attempt:
                price = r.price
                continue
            status, reason, previous = decided(r, price)
            if status == "updated":
                price = r.price
            elif reason == "not_found" and r.store in clearing:
                price = None
            out.append((True, r.run, r.store, r.item, r.seq, status, reason, previous, price))
        yield table(out)
    yield table(ended())


def refreshed(attempts: DataFrame, blocked: DataFrame, known: DataFrame, clearing: Iterable[str] = ()) -> DataFrame:
    """FOLDED: RESULT of some attempts (ATTEMPT), one row for each, and rows that are no attempt with the prices known after them (KNOWN).

    blocked: BLOCKED with these attempts in it (first_blocks); known: KNOWN before them. seq orders the attempts of a run and of an item, and later
    ones are expected to come after. sku: null or empty if there is none to fetch. outcome: offer, miss, blocked (the store refuses everything) or error.
    impostor: why an offer is another product, which counts unless the link is locked. clearing: stores where a miss clears the known price. Repeated
    attempts are attempts of their own; null outcomes and prices are misses; null runs, stores and items are keys.
    """
    first = blocked.select(F.col("run").alias("in_run"), F.col("store").alias("in_store"), F.col("seq").alias("since"), F.col("message").alias("said"))
    same = F.col("run").eqNullSafe(F.col("in_run")) & F.col("store").eqNullSafe(F.col("in_store"))
    flagged = attempts.join(first, same, "left").select(*attempts.columns, F.expr("CASE WHEN seq > since THEN said END").alias("blocked_by"), F.lit(True).alias("attempt"))
    rows = flagged.unionByName(known.withColumn("attempt", F.lit(False)), allowMissingColumns=True).select(*Attempt._fields)
    order = ["store", "item", "attempt", F.col("seq").asc_nulls_last(), *[c for c in Attempt._fields if c not in ("store", "item", "attempt", "seq")]]
    stores = frozenset(clearing)
    return rows.repartition("store", "item").sortWithinPartitions(*order).mapInArrow(lambda it: _folded(it, stores), FOLDED)


def land_refreshed(spark: SparkSession, folder: str, out: str, checkpoint: str, clearing: Iterable[str] = ()) -> StreamingQuery:
    """Runs refreshed() over the Parquet files that have landed in `folder` and waits for nothing; results go to `out`, a folder a micro-batch.

    A micro-batch reads the states that the one before has left in the checkpoint's folder and writes its own beside them, in turn into two
    places. One that is run again after a failure reads the same states and writes the same folders again, so a replay gives the same rows.
    """
    stores = frozenset(clearing)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        place = lambda state, n: f"{checkpoint}/{state}/{n % 2}"
        before = lambda state, schema: own.read.schema(schema).parquet(place(state, number - 1)) if number else own.createDataFrame([], schema)
        first_blocks(batch, before("blocked", BLOCKED)).write.mode("overwrite").parquet(place("blocked", number))
        blocked = own.read.schema(BLOCKED).parquet(place("blocked", number))
        folded = refreshed(batch, blocked, before("known", KNOWN), stores).persist(StorageLevel.DISK_ONLY)
        try:
            folded.where("attempt").drop("attempt").write.mode("overwrite").parquet(f"{out}/batch={number}")
            folded.where("not attempt").select("store", "item", "price").write.mode("overwrite").parquet(place("known", number))
        finally:
            folded.unpersist()

    stream = spark.readStream.schema(ATTEMPT).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
