"""Baskets: coverage, one-store and mixed totals, winners, restricted totals."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.money import TIE, r2

#: Lines of carts that one task holds in a hash map: its memory stays as it is when the table grows.
TASK_ROWS = 1 << 20


def best_offers(offers: DataFrame) -> DataFrame:
    """(item, store, price): the cheapest offer of an item in a store; null prices are no offers."""
    return offers.where("price is not null").groupBy("item", "store").agg(F.min("price").alias("price"))


def _spread(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows by keys, over more partitions than the session's where a task would hold over TASK_ROWS of n_rows."""
    n = -(-n_rows // TASK_ROWS)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def offered_lines(lines: DataFrame, best: DataFrame) -> DataFrame:
    """(cart, item, offers) of every line, partitioned by cart: array<struct<store, cost>> of the stores that sell the item, empty if none does.

    A repeated item is one line with its quantities summed. Offers travel as one array a line, so what follows by cart, or by cart and
    item, needs no shuffle. Lines meet after their shuffle, not before: hardly one repeats, and a hash map of all that a task reads would be for nothing.
    """
    n_rows = lines.count()
    wanted = _spread(lines, n_rows, "cart", "item").groupBy("cart", "item").agg(F.sum("quantity").alias("quantity"))
    stores = best.groupBy("item").agg(F.collect_list(F.struct("store", "price")).alias("offers"))
    costs = F.transform("offers", lambda x: F.struct(x["store"].alias("store"), (x["price"] * F.col("quantity")).alias("cost")))
    none = F.array().cast(f"array<struct<store:{best.schema['store'].dataType.simpleString()},cost:double>>")
    return _spread(wanted.join(stores, "item", "left"), n_rows, "cart").select("cart", "item", F.coalesce(costs, none).alias("offers"))


def priced_lines(lines: DataFrame, best: DataFrame) -> DataFrame:
    """(cart, item, store, cost) of every line in every store that sells the item; a repeated item is one line with its quantities summed.

    The rows fan out by the stores of an item, not by all stores, and only after the last shuffle.
    """
    return offered_lines(lines, best).select("cart", "item", F.inline("offers"))


def coverage(lines: DataFrame, priced: DataFrame) -> DataFrame:
    """(cart, store, n_lines, n_priced, total): total only where a store prices every line."""
    wanted = lines.groupBy("cart").agg(F.count_distinct("item").alias("n_lines"))
    found = priced.groupBy("cart", "store").agg(F.count("*").alias("n_priced"), F.sum("cost").alias("sum_cost"))
    return found.join(wanted, "cart").select("cart", "store", "n_lines", "n_priced", _total())


def _total() -> Column:
    return F.when(F.col("n_priced") == F.col("n_lines"), r2(F.col("sum_cost"))).alias("total")


def coverage_of(offered: DataFrame) -> DataFrame:
    """As coverage, of offered_lines: the number of lines is counted with the stores, in one pass."""
    line = F.col("item").isNotNull().cast("int")
    none = F.struct(F.lit(None).alias("store"), F.lit(None).alias("cost"), line.alias("line"), F.lit(0).alias("priced"))
    each = F.transform("offers", lambda x: F.struct(x["store"].alias("store"), x["cost"].alias("cost"), F.lit(0).alias("line"), F.lit(1).alias("priced")))
    rows = offered.where("cart is not null").select("cart", F.inline(F.concat(F.array(none), each)))
    found = rows.groupBy("cart", "store").agg(F.sum("line").alias("line"), F.sum("priced").alias("n_priced"), F.sum("cost").alias("sum_cost"))
    counted = found.withColumn("n_lines", F.sum("line").over(Window.partitionBy("cart")))
    return counted.where("n_priced > 0").select("cart", "store", "n_lines", "n_priced", _total())


def winner(complete: DataFrame) -> DataFrame:
    """(cart, winner, total) over coverage rows: a store, 'tie' within half a cent, or 'incomplete'. One aggregation."""
    carts = complete.where("cart is not null").groupBy("cart").agg(F.min("total").alias("total"), F.collect_list(F.struct("total", "store")).alias("c"))
    near = F.filter("c", lambda x: x["store"].isNotNull() & (F.abs(x["total"] - F.col("total")) < TIE))
    stores = carts.select("cart", "total", F.transform(near, lambda x: x["store"]).alias("near"))
    name = F.when(F.size("near") == 0, "incomplete").when(F.size("near") > 1, "tie").otherwise(F.get("near", F.lit(0)).cast("string"))
    return stores.select("cart", name.alias("winner"), "total")


def mixed(priced: DataFrame) -> DataFrame:
    """(cart, store, n_items, subtotal): every line at its cheapest store, the smaller store among equals."""
    return _subtotals(priced.groupBy("cart", "item").agg(F.min(F.struct("cost", "store")).alias("m")))


def mixed_of(offered: DataFrame) -> DataFrame:
    """As mixed, of offered_lines."""
    cheapest = F.array_min(F.transform("offers", lambda x: F.struct(x["cost"].alias("cost"), x["store"].alias("store"))))
    return _subtotals(offered.select("cart", cheapest.alias("m")).where("m is not null"))


def _subtotals(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("cart", F.col("m.store").alias("store")).agg(F.count("*").alias("n_items"), r2(F.sum("m.cost")).alias("subtotal"))


def restricted_totals(wide: DataFrame, stores: list[str]) -> DataFrame:
    """(stores, n, store, total) for every set of two or more stores, over the rows that all of them price; one aggregation."""
    sets = [c for k in range(2, len(stores) + 1) for c in combinations(stores, k)]
    all_of = lambda c: F.expr(" and ".join(f"{s} is not null" for s in c))
    parts = [
        F.struct(
            F.lit("+".join(c)).alias("stores"), F.lit(s).alias("store"), F.count_if(all_of(c)).alias("n"), r2(F.sum(F.when(all_of(c), F.col(s)))).alias("total"),
        )
        for c in sets for s in c
    ]
    return wide.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def missing_stores(wide: DataFrame, stores: list[str]) -> DataFrame:
    """(item, missing): rows that some store does not price, with the names of those stores."""
    gone = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in stores]))
    return wide.select("item", F.array_join(gone, ",").alias("missing")).where("missing <> ''")


def procurement_cost(product: Column, stops: Column, wage: float = 20, hours: float = 1, vehicle: float = 5, extra_stop: float = 3) -> Column:
    """Products, labour, vehicle and a charge for every stop after the first."""
    return r2(r2(product) + r2(F.lit(float(wage * hours))) + F.lit(float(vehicle)) + r2(F.greatest(stops - 1, F.lit(0)) * extra_stop))


def plan_combos(wide: DataFrame, stores: list[str], most: int = 3) -> DataFrame:
    """(stores, n_stores, n_covered, total) of every set of up to `most` stores: each line at its cheapest store of the set."""
    sets = [c for k in range(1, most + 1) for c in combinations(stores, k)]
    cheapest = lambda c: F.least(*[F.col(s) for s in c]) if len(c) > 1 else F.col(c[0])
    parts = [
        F.struct(F.lit("+".join(c)).alias("stores"), F.lit(len(c)).alias("n_stores"), F.count(cheapest(c)).alias("n_covered"), r2(F.sum(cheapest(c))).alias("total"))
        for c in sets
    ]
    return wide.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def unit_rank(offers: DataFrame) -> DataFrame:
    """Adds rank_key: the price, or the price of a kilogram where packs of an item differ by over 20 %.

    offers: item, store, price, kg. One pass over each item's offers.
    """
    w = Window.partitionBy("item")
    apart = (F.max("kg").over(w) - F.min("kg").over(w)) / F.min("kg").over(w) > 0.2
    return offers.withColumn("rank_key", F.when(apart & (F.col("kg") > 0), r2(F.col("price") / F.col("kg"))).otherwise(F.col("price")))
