"""Provenance, staleness, plausibility, rejection reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from larder.functions.expr import fresh
from larder.functions.money import prices_agree


def price_confidence(live: Column, exact: Column, age_hours: Column, receipt: Column, linked: Column, other: Column, limit: float = 72) -> Column:
    """The ladder of price provenance, best rung first."""
    fresh = (live > 0) & exact & (age_hours.isNull() | (age_hours <= limit))
    return (
        F.when(fresh & prices_agree(live, receipt), "MULTI_SOURCE_CONFIRMED").when(fresh & linked & prices_agree(live, other), "MULTI_SOURCE_CONFIRMED")
        .when(fresh, "LIVE_VERIFIED").when(receipt > 0, "RECEIPT_VERIFIED").when(live > 0, "ESTIMATED").otherwise("UNKNOWN")
    )


def age_hours(ts: Column, as_of: str) -> Column:
    """Hours from ts to as_of, both without a zone."""
    return F.timestamp_diff("SECOND", ts, F.lit(as_of).cast("timestamp_ntz")) / 3600


def plausible(price: Column, least: Column, most: Column) -> Column:
    return F.when(price <= 0, "rejected").when(price < least, "wrong_pack").when(price > most, "rejected").otherwise("ok")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])


def keep_if_any(rows: DataFrame, key: str, preferred: Column) -> DataFrame:
    """Of each group only the preferred rows, if it has any; else all. A null key is a group.

    Which groups have one is an aggregation combined before its shuffle, so no group is sorted in one task.
    """
    own, has, of = (fresh(c, rows.columns) for c in ("own", "has", "of"))
    marked = rows.withColumn(own, F.coalesce(preferred, F.lit(False)))
    groups = marked.groupBy(F.col(key).alias(of)).agg(F.bool_or(own).alias(has))
    return marked.join(groups, F.col(key).eqNullSafe(F.col(of))).where(F.col(own) | ~F.col(has)).select(rows.columns)


def latest(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The latest row of each key with a value, ties by the following order columns; one map-side aggregation."""
    return rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max(F.struct(*order, value)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in (*order, value)])


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Field by field, the overlay where it has a value; rows of either side stay."""
    columns = [c for c in base.columns if c != key]
    b, o = base.alias("b"), over.alias("o")
    return b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full").select(
        F.coalesce(f"b.{key}", f"o.{key}").alias(key), *[F.coalesce(f"o.{c}", f"b.{c}").alias(c) for c in columns]
    )
