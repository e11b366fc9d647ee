"""What a requested amount costs from packs or loose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import units
from larder.functions.expr import let
from larder.functions.money import packs_needed, r2

#: Most packs of one purchase: of things that are counted, and of all others; fixed values.
MOST_COUNTED, MOST_PACKS = 40, 6
NO_PACK, NO_MATCH, NO_MAXIMUM, OVER = "no_pack_of_near_size", "no_match", "no_maximum", "over_maximum"


def loose(price_per_unit: Column, amount: Column) -> Column:
    """struct<packs, got, total> of an amount weighed out."""
    return F.struct(F.lit(None).cast("long").alias("packs"), amount.alias("got"), r2(price_per_unit * amount).alias("total"))


def covering_packs(price: Column, pack: Column, need: Column) -> Column:
    """struct<packs, got, total> of the fewest packs that cover a need."""
    n = packs_needed(need, pack)
    return F.struct(n.alias("packs"), (n * pack).alias("got"), r2(price * n).alias("total"))


def needed_weight(price: Column, pack: Column, need: Column, below: float = 0.10, above: float = 0.15, most: int = 30) -> Column:
    """struct<in_range, packs, got, total>: the cheapest count within the window around the need, then the nearest; else the covering count."""
    low, high = F.ceil(need * (1 - below) / pack - 1e-9), F.least(F.floor(need * (1 + above) / pack + 1e-9), F.lit(most))
    counts = F.when(F.greatest(low, F.lit(1)) <= high, F.sequence(F.greatest(low, F.lit(1)).cast("long"), high.cast("long")))
    plan = F.array_min(F.transform(counts, lambda n: F.struct(r2(price * n).alias("total"), F.abs(n * pack - need).alias("off"), n.alias("packs"))))
    cover = packs_needed(need, pack)
    n = F.coalesce(plan["packs"], cover)
    return F.struct(plan.isNotNull().alias("in_range"), n.alias("packs"), (n * pack).alias("got"), r2(price * n).alias("total"))


def pack_counts(pack: Column, least: Column, most_amount: Column, most: Column) -> Column:
    """Counts of packs whose sum lies from least to most_amount, `most` at most; empty if there is none or no upper bound."""
    low = F.greatest(F.ceil(least / pack - 1e-9), F.lit(1)).cast("long")
    high = F.least(F.floor(most_amount / pack + 1e-9).cast("long"), most.cast("long"))
    return F.when((pack > 0) & most_amount.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)"))


def most_packs(counted: Column) -> Column:
    return F.when(counted, MOST_COUNTED).otherwise(MOST_PACKS)


def _plan(valid: Column, reason: Column, packs: Column, pack: Column, price: Column, need: Column) -> Column:
    """struct<valid, reason, packs, got, extra, total, unit>: an invalid plan has no total."""
    got, total = packs * pack, r2(packs * price)
    return F.struct(
        valid.alias("valid"), F.when(~valid, reason).alias("reason"), packs.cast("long").alias("packs"), r2(got).alias("got"),
        r2(F.greatest(got - need, F.lit(0.0))).alias("extra"), F.when(valid, total).alias("total"), F.when(got > 0, r2(total / got)).alias("unit"),
    )


def stock_up(price: Column, pack: Column, need: Column, maximum: Column, counted: Column | bool = False) -> Column:
    """Plan (see _plan) of the count between need and maximum with the least price of a unit, then the least cost, then the fewest packs.

    At most 40 packs of counted things and 6 of others. Without a maximum or a count that fits the plan is invalid.
    """
    counted = counted if isinstance(counted, Column) else F.lit(counted)
    counts = pack_counts(pack, need, maximum, most_packs(counted))
    options = F.transform(counts, lambda n: F.struct(r2(r2(price * n) / (n * pack)).alias("unit"), r2(price * n).alias("total"), n.alias("packs")))
    reason = F.when(maximum.isNull(), NO_MAXIMUM).otherwise(NO_PACK)
    return let(F.array_min(options), lambda best: _plan(best.isNotNull(), reason, F.coalesce(best["packs"], packs_needed(need, pack)), pack, price, need))


def exact_need(price: Column, pack: Column, need: Column, percent: float | Column = 15, counted: Column | bool = False) -> Column:
    """Plan (see _plan) of the covering count if it lies within percent of the need, else of the fewest packs that do.

    Of counted things a covering count is also valid if one pack is no more than the upper bound: a carton cannot be split.
    """
    counted = counted if isinstance(counted, Column) else F.lit(counted)
    share = (percent if isinstance(percent, Column) else F.lit(float(percent))) / 100
    low, high = need * (1 - share), need * (1 + share)
    n = packs_needed(need, pack)
    fits = (n * pack + 1e-6 >= low) & (n * pack - 1e-6 <= high) & (n <= most_packs(counted))
    whole = counted & (n * pack + 1e-6 >= low) & ((pack <= high + 1e-6) | (n * pack <= high + 1e-6))
    other = F.get(pack_counts(pack, low, high, most_packs(counted)), F.lit(0))
    chosen = F.struct((whole | fits).alias("cover"), other.alias("other"), n.alias("n"))
    return let(chosen, lambda x: _plan(x["cover"] | x["other"].isNotNull(), F.lit(NO_PACK), F.when(x["cover"], x["n"]).otherwise(F.coalesce(x["other"], x["n"])), pack, price, need))


def pack_in_unit(text: Column, parsed_kg: Column, unit: Column) -> Column:
    """What one pack holds in the unit of a product (g kg ml l ea pack); null if a mass or volume is not known."""
    kg = F.coalesce(units.parse_amount(text), F.when(parsed_kg > 0, parsed_kg))
    ml, count = units.parse_volume_ml(text), units.count_pack(text)
    return (
        F.when(unit == "g", kg * 1000).when(unit == "kg", kg).when(unit == "ml", ml).when(unit == "l", ml / 1000)
        .when(unit == "ea", F.coalesce(count["total"], F.lit(1)).cast("double")).otherwise(F.coalesce(count["outer"], F.lit(1)).cast("double"))
    )


def loose_unit_price(text: Column, price: Column, per_kg: Column, unit: Column) -> Column:
    """Price of a kilogram or gram sold by weight: that given, a rate in the text, or the price where the text says per kg."""
    rated = let(units.embedded_rates(text), lambda r: F.coalesce(r["per_kg"], r["per_lb"] / units.KG_PER_LB))
    found = F.coalesce(F.when(per_kg > 0, per_kg), rated, F.when(F.lower(text).rlike(r"per\s*kg"), price))
    return let(found, lambda x: F.when(x > 0, F.when(unit == "kg", x).when(unit == "g", x / 1000)))


def purchase_facts(offer: dict[str, Column], unit: Column) -> Column:
    """struct<mode, per, pack, counted>: what an offer's text says for a purchase, whatever the amount; see evaluate_purchase."""
    text = F.concat(offer["name"], F.lit(" "), F.coalesce(offer["size"], F.lit("")))
    return F.struct(
        units.sale_mode(text, offer["by_weight"], offer["parsed_kg"]).alias("mode"), loose_unit_price(text, offer["price"], offer["per_kg"], unit).alias("per"),
        pack_in_unit(text, offer["parsed_kg"], unit).alias("pack"), (units.dimension_of(unit) == "count").alias("counted"),
    )


def purchase(x: Column, price: Column, strategy: Column, need: Column, maximum: Column, percent: Column) -> Column:
    """The result of evaluate_purchase from the facts `x` of an offer."""
    none = lambda reason: _plan(F.lit(False), F.lit(reason), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    over = (strategy == "stock_up") & F.coalesce(need - 1e-6 > maximum, F.lit(False))
    weighed = F.struct(
        (~over).alias("valid"), F.when(over, OVER).alias("reason"), F.lit(1).cast("long").alias("packs"), r2(need).alias("got"), F.lit(0.0).alias("extra"),
        F.when(~over, r2(need * x["per"])).alias("total"), r2(x["per"]).alias("unit"),
    )
    plan = (
        F.when(~F.coalesce((price > 0) & (need > 0), F.lit(False)), none(NO_MATCH))
        .when(x["mode"] == "loose_weight", F.when(x["per"].isNull(), none(NO_PACK)).otherwise(weighed))
        .when(x["pack"].isNull() | (x["pack"] <= 0), none(NO_PACK))
        .when(strategy == "stock_up", stock_up(price, x["pack"], need, maximum, x["counted"])).otherwise(exact_need(price, x["pack"], need, percent, x["counted"]))
    )
    return let(plan, lambda p: F.struct(*[p[c].alias(c) for c in ("valid", "reason", "packs", "got", "extra", "total", "unit")], x["mode"].alias("sale_mode")))


def evaluate_purchase(offer: dict[str, Column], unit: Column, strategy: Column, need: Column, maximum: Column, percent: Column) -> Column:
    """struct<valid, reason, packs, got, extra, total, unit, sale_mode>: what an amount of a product costs as this offer.

    offer: name, size, price, per_kg, parsed_kg, by_weight. unit: of need and maximum. strategy: stock_up or exact_need.
    Offers sold loose cost their weight, others whole packs, by their strategy.
    """
    return let(purchase_facts(offer, unit), lambda x: purchase(x, offer["price"], strategy, need, maximum, percent))


def cheapest_covering(plans: DataFrame, key: str, order: str) -> DataFrame:
    """The offer of each key with the least total among valid plans, the first by `order` among equals: one aggregation.

    plans: key, order, and plan as of evaluate_purchase.
    """
    rows = plans.where("plan.valid").select(key, F.struct(F.col("plan.total").alias("total"), F.col(order), F.col("plan")).alias("m"))
    return rows.groupBy(key).agg(F.min_by("m", F.struct("m.total", f"m.{order}")).alias("m")).select(key, f"m.{order}", "m.plan")


def pack_buckets(offers: DataFrame, most: int = 10) -> DataFrame:
    """The cheapest offer of each 5 g bucket of an item, at most `most` buckets by size: the feature of the operator is that report.

    offers: item, offer_id, grams, price.
    """
    bucket = (F.floor(F.col("grams") / 5 + 0.5) * 5).cast("long")
    best = offers.withColumn("bucket", bucket).groupBy("item", "bucket").agg(F.min(F.struct("price", "offer_id")).alias("b"))
    listed = best.groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("bucket", F.col("b.offer_id").alias("offer_id"), F.col("b.price").alias("price")))), 1, most).alias("rows"))
    return listed.select("item", F.inline("rows"))
