"""Shown stores, and an operator's yes or no on the offer of an item in a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.expr import let
from larder.functions.money import TIE, r2

#: Fixed values, in the order of columns.
STORES = ["walmart", "nofrills", "wholesaleclub", "mvr"]
EPOCH = "1970-01-01T00:00:00.000Z"
VERDICT = "struct<stapleId:string,id:string,label:string,store:string,verdict:string,empty:boolean,productId:string,name:string,image:string,price:string,ratedAt:string,updatedAt:string>"


def parse_stores(raw: Column) -> Column:
    """The stores named in a JSON array or a list with commas, each once and in that order; all of them if there is none."""
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.when(~F.trim(raw).startswith("["), F.split(raw, ",")))
    known = F.array_distinct(F.filter(F.transform(listed, F.trim), lambda s: s.isin(STORES)))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*map(F.lit, STORES)))


def toggle_store(enabled: Column, store: Column) -> Column:
    """The shown stores with this one added or, unless it is the last, taken out."""
    there = F.array_contains(enabled, store)
    return F.when(~there, F.array_append(enabled, store)).when(F.size(enabled) > 1, F.array_remove(enabled, store)).otherwise(enabled)


def cheaper_among(costs: dict[str, Column], enabled: Column) -> Column:
    """(cheaper, delta): the store of the least cost among the shown ones, 'tie' within half a cent, 'incomplete' with less than two costs.

    delta: least minus second least, so never above zero.
    """
    one = lambda s, c: F.when(F.array_contains(enabled, F.lit(s)) & c.isNotNull() & ~F.isnan(c), F.struct(c.alias("cost"), F.lit(s).alias("store")))
    priced = F.filter(F.array(*[one(s, c.cast("double")) for s, c in costs.items()]), lambda p: p.isNotNull())

    def judged(p: Column) -> Column:
        values = F.array_sort(F.transform(p, lambda x: x["cost"]))
        least = F.get(values, F.lit(0))
        near = F.filter(p, lambda x: F.abs(x["cost"] - least) < TIE)
        return F.struct(
            F.when(F.size(p) < 2, "incomplete").when(F.size(near) > 1, "tie").otherwise(F.get(near, F.lit(0))["store"]).alias("cheaper"),
            F.when(F.size(p) >= 2, r2(least - F.get(values, F.lit(1)))).alias("delta"),
        )

    return let(priced, judged)


def _short(c: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, most)


def parse_verdicts(texts: DataFrame, column: str = "payload") -> DataFrame:
    """Verdicts in pasted texts: item, label, store, verdict, empty, product_id, name, image, price, rated_at.

    A text is a JSON array of verdicts, an object that holds them as `verdicts` (an array, or an object by key), or an object by
    key, in a code fence or not. Rows without an item, a known store or a yes or no are left out; so is a text that is no JSON.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"^(?i)```(?:json)?\s*", ""), r"\s*```$", ""))
    held = F.coalesce(F.get_json_object("t__", "$.verdicts"), F.col("t__"))
    by_key = F.map_filter(F.from_json("h__", "map<string,string>"), lambda k, v: ~k.isin("kind", "updatedAt", "yes", "no"))
    found = F.when(F.col("h__").startswith("["), F.from_json("h__", "array<string>")).otherwise(F.map_values(by_key))
    read = texts.select(bare.alias("t__")).withColumn("h__", F.trim(held)).select(F.explode(found).alias("j__")).select(F.from_json("j__", VERDICT).alias("v"), F.get_json_object("j__", "$.verdict").alias("said"))
    item = F.coalesce(F.col("v.stapleId"), F.col("v.id"))
    verdict = F.when(F.col("said").isin("yes", "true", "так"), "yes").when(F.col("said").isin("no", "false", "ні", "ni"), "no")
    number = F.nanvl(F.col("v.price").try_cast("double"), F.lit(None))
    made = read.select(
        _short(item, 80).alias("item"), _short(F.col("v.label"), 120).alias("label"), _short(F.col("v.store"), 32).alias("store"), verdict.alias("verdict"),
        F.coalesce("v.empty", F.lit(False)).alias("empty"), _short(F.col("v.productId"), 80).alias("product_id"), _short(F.col("v.name"), 200).alias("name"),
        _short(F.col("v.image"), 500).alias("image"), F.when(number > 0, number).alias("price"),
        _short(F.coalesce(F.nullif(F.col("v.ratedAt"), F.lit("")), F.nullif(F.col("v.updatedAt"), F.lit("")), F.lit(EPOCH)), 40).alias("rated_at"),
    )
    kept = made.where(F.col("verdict").isNotNull() & (F.col("item") != "") & F.col("store").isin(STORES))
    return (
        kept.withColumn("empty", F.col("empty") | (F.col("product_id") == "")).withColumn("label", F.when(F.col("label") != "", F.col("label")).otherwise(F.col("item")))
        .withColumn("image", F.nullif(F.col("image"), F.lit("")))
    )


def applied(cells: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The cells with `verdict`, null where there is none for the product they show. cells: item, store, product_id; a missing product is the empty one."""
    said = verdicts.select("item", "store", F.col("product_id").alias("for__"), "verdict")
    return cells.join(said, ["item", "store"], "left").withColumn("verdict", F.when(F.trim(F.coalesce("product_id", F.lit(""))) == F.col("for__"), F.col("verdict"))).drop("for__")


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: yes, no, empty_yes, empty_no, total."""
    yes, no = F.col("verdict") == "yes", F.col("verdict") == "no"
    return verdicts.agg(
        F.count_if(yes).alias("yes"), F.count_if(no).alias("no"), F.count_if(yes & F.col("empty")).alias("empty_yes"), F.count_if(no & F.col("empty")).alias("empty_no"),
        F.count_if(yes | no).alias("total"),
    )


def progress(cells: DataFrame) -> DataFrame:
    """By item, of cells with a verdict (see applied): rated, total, no, unrated, has_unrated, has_no."""
    counts = cells.groupBy("item").agg(F.count("verdict").alias("rated"), F.count("*").alias("total"), F.count_if(F.col("verdict") == "no").alias("no"))
    return counts.withColumn("unrated", F.col("total") - F.col("rated")).withColumn("has_unrated", F.col("unrated") > 0).withColumn("has_no", F.col("no") > 0)
