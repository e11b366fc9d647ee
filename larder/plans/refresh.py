"""The stream of price refreshes as a query: events stand for the attempts of daily runs; its SQL walks the whole log by recursion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.plans.catalogue import ORACLE, QUERIES
from larder.sources.shared import shared_dir
from larder.streaming import refresh

CLEARING = ["s0"]
ATTEMPTS = {
    "run": "concat('run-', {day})", "store": "concat('s', user_id % 4)", "item": "user_id", "seq": "event_id", "sku": "CASE WHEN event_id % 17 > 0 THEN 'sku' END",
    "outcome": "CASE WHEN event_type = 'error' AND event_id % 29 = 0 THEN 'blocked' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'miss' ELSE 'offer' END",
    "price": "CASE WHEN event_id % 23 = 0 THEN 0 ELSE value END", "impostor": "CASE WHEN event_id % 13 = 0 THEN 'form' END", "locked": "user_id % 3 = 0",
    "message": "CASE WHEN event_type = 'error' AND event_id % 29 = 0 THEN '403' WHEN event_type = 'error' THEN 'timeout' END",
}

SQL = f"""WITH RECURSIVE a AS (SELECT {", ".join(f"{e.format(day='CAST(CAST(ts AS DATE) AS VARCHAR)')} AS {c}" for c, e in ATTEMPTS.items())} FROM events),
b AS (SELECT run, store, min(seq) AS first, arg_min(message, seq) AS said FROM a WHERE outcome = 'blocked' AND sku IS NOT NULL GROUP BY run, store),
f AS (SELECT a.*, CASE WHEN seq > first THEN said END AS blocked_by, row_number() OVER (PARTITION BY store, item ORDER BY seq) AS r FROM a LEFT JOIN b USING (run, store)),
w AS (
  SELECT NULL::VARCHAR AS run, store, item, CAST(NULL AS BIGINT) AS seq, NULL::VARCHAR AS status, NULL::VARCHAR AS reason, NULL::DOUBLE AS previous, NULL::DOUBLE AS price, CAST(0 AS BIGINT) AS r FROM (SELECT DISTINCT store, item FROM f)
  UNION ALL
  SELECT run, store, item, seq, CASE WHEN reason IS NULL THEN 'updated' WHEN reason = 'no_sku' THEN 'skipped' ELSE 'failed' END, reason, known,
    CASE WHEN reason IS NULL THEN offered WHEN reason = 'not_found' AND store = 's0' THEN NULL ELSE known END, r
  FROM (SELECT f.run, f.store, f.item, f.seq, f.r, w.price AS known, f.price AS offered, CASE WHEN sku IS NULL THEN 'no_sku' WHEN blocked_by IS NOT NULL THEN blocked_by WHEN outcome IN ('blocked', 'error') THEN message
      WHEN outcome = 'miss' OR f.price IS NULL THEN 'not_found' WHEN w.price > 0 AND f.price > 0 AND greatest(w.price, f.price) / least(w.price, f.price) >= 4 THEN 'price_jump'
      WHEN f.price <= 0 THEN 'rejected' WHEN impostor IS NOT NULL AND NOT locked THEN impostor END AS reason
    FROM w JOIN f ON f.store = w.store AND f.item = w.item AND f.r = w.r + 1)
)
SELECT run, store, item, seq, status, reason, previous, price FROM w WHERE r > 0"""


def price_refresh_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lands in two parts, and the stream runs after each: the second run goes on from the state of the first."""
    folder = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}"
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(*[F.expr(e.format(day="to_date(ts)")).alias(c) for c, e in ATTEMPTS.items()])
    log = log.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in refresh.ATTEMPT.split(", ")])
    middle = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        log.where(part).write.mode("append").parquet(f"{folder}/landed")
        refresh.land_refreshed(spark, f"{folder}/landed", f"{folder}/out", f"{folder}/state", CLEARING).awaitTermination()
    return spark.read.schema(refresh.RESULT).parquet(f"{folder}/out").drop("batch")


QUERIES["price_refresh_stream"], ORACLE["price_refresh_stream"] = price_refresh_stream, SQL
