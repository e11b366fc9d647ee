"""The comparison row of an item: what its four stores charge for one and the same amount.

The stores are coupled. If their packs are of different size, all have to cover the largest; the amount then decides purchases,
purchases decide baskets, and the fair comparison is overridden in a fixed order: by a rejected identity, by the needed weight, by
what is paid at the checkout. An item has at most one offer a store, so its offers are pivoted by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import units
from larder.functions.expr import let
from larder.functions.money import TIE, present, r2, similar
from larder.operators import costing

#: Grams of an item sold by weight where nobody says how much; fixed value.
DEFAULT_GRAMS = 1000.0
OFFER = ["product_id", "name", "size", "price", "parsed_kg", "retailer", "ok", "identity_reason", "status"]


def shared_cover(kgs: Column, qty: Column) -> Column:
    """Grams that packs of different size have to cover: the largest, rounded, times qty; null under two masses or if all are alike."""
    known = F.filter(kgs, lambda k: F.coalesce(k > 0, F.lit(False)))
    alike = similar(F.array_min(known), F.array_max(known))
    return F.when((F.size(known) >= 2) & ~alike, F.floor(F.array_max(known) * 1000 + 0.5) * F.greatest(F.floor(F.coalesce(qty, F.lit(1.0)) + 0.5), F.lit(1)))


def needed_grams(weighed: Column, cheapest: Column, egg: Column, supplies: Column, grams: Column, cover: Column) -> Column:
    """struct<grams, shared>: what the user asks for, by weight 1000 g where nobody does, else the shared cover."""
    asked = F.when(grams > 0, grams)
    own = F.when(weighed, F.coalesce(asked, F.lit(DEFAULT_GRAMS))).when(cheapest & ~egg, asked)
    shared = F.when(own.isNull() & ~weighed & ~egg & ~supplies, cover)
    return F.struct(F.coalesce(own, shared).cast("double").alias("grams"), (own.isNull() & shared.isNotNull()).alias("shared"))


def weight_plan(x: Column, needed: Column) -> Column:
    """struct<packs, got, total> of a needed weight from the facts of an offer, null without a price or a mass; see costing.needed_weight."""

    def packed(grams: Column) -> Column:
        return let(costing.needed_weight(x["price"], grams, needed), lambda p: F.struct(p["packs"].alias("packs"), r2(p["got"]).alias("got"), p["total"].alias("total")))

    loose = F.struct(F.lit(0).cast("long").alias("packs"), needed.alias("got"), r2(x["per_kg"] * (needed / 1000)).alias("total"))
    usable = (needed > 0) & (x["price"] > 0)
    return F.when(usable & (x["buy"]["mode"] == "loose_weight"), F.when(x["per_kg"] > 0, loose)).when(usable & (x["plan_kg"] > 0), let(x["plan_kg"] * 1000, packed))


def offer_facts(offers: DataFrame) -> DataFrame:
    """(item, store, product_id, facts) of offers joined with the settings of their items: all that is read from their texts, once an offer.

    facts: price, ok, reason, status, kg (content, or that of a piece), plan_kg (for a needed weight: printed, of a piece, or parsed before), pack_kg
    (printed), per_kg, per_each and buy (see costing.purchase_facts).
    """
    text = F.concat_ws(" ", "name", "size")
    args = [F.col(c) for c in ("product_id", "name", "size", "retailer", "price")] + [F.lit(None).cast("double")]
    sized = F.coalesce(units.parse_mass(F.col("size")), units.parse_mass(F.col("name"))).isNotNull()
    read = offers.withColumns({
        "pack_kg": units.pack_mass_kg(text, F.lit(None).cast("double")), "content": units.content_kg(text, F.col("parsed_kg")),
        "each_kg": F.when((F.col("each_grams") > 0) & F.lower(text).rlike(units.EACH), F.col("each_grams") / 1000),
        "per_kg": F.when(F.col("produce") & ~F.col("egg"), F.when(sized, units.unit_prices(*args)["per_kg"]).otherwise(units.unit_prices(*args, by_weight=True)["per_kg"])),
        "pieces": F.when(F.col("egg"), units.count_pack(text)["total"]),
    })
    offer = {c: F.col(c) for c in ("name", "size", "price", "per_kg", "parsed_kg")} | {"by_weight": F.col("weighed")}
    parsed = F.when(F.col("parsed_kg") > 0, F.col("parsed_kg"))
    return read.select(
        "item", "store", "product_id",
        F.struct(
            F.col("product_id"), F.col("price").cast("double").alias("price"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("identity_reason").alias("reason"), "status",
            F.coalesce("content", "each_kg").alias("kg"), F.coalesce(F.col("pack_kg"), F.col("each_kg"), parsed).alias("plan_kg"), "pack_kg", "per_kg",
            F.when(F.col("pieces") > 0, r2(F.col("price") / F.col("pieces"))).alias("per_each"), costing.purchase_facts(offer, F.col("unit")).alias("buy"),
        ).alias("facts"),
    )


SIDE = "struct<ok:boolean,shelf:double,line:double,per_kg:double,per_each:double,pack_kg:double,egg:boolean>"
_NEITHER = "struct<basis:string,label:string,cheaper:string,delta:double>"


def cheapest_at(values: Column, stores: list[str]) -> Column:
    """As compare.cheapest_of, for an array with a value or null for each store."""

    def named(v: Column) -> Column:
        known = F.array_compact(v)
        near = F.filter(F.zip_with(v, F.array(*map(F.lit, stores)), lambda x, s: F.when(F.abs(x - F.array_min(known)) < TIE, s)), lambda s: s.isNotNull())
        return F.when(F.size(known) < 2, "incomplete").when(F.size(near) > 1, "tie").otherwise(F.get(near, F.lit(0)))

    return let(values, named)


def spread_at(values: Column) -> Column:
    """The least value less the next, null under two."""
    return let(F.array_sort(F.array_compact(values)), lambda v: F.when(F.size(v) > 1, r2(F.get(v, F.lit(0)) - F.get(v, F.lit(1)))))


def fair_sides(sides: Column, stores: list[str]) -> Column:
    """struct<basis, label, cheaper, delta> of an array of SIDE, one for each store.

    The first rule that all usable sides meet: price of an egg, shelf price of packs that are alike, price of 100 g, price of the line.
    If a side beyond the second is usable but they meet none, the first two are compared by themselves. The delta of two is
    first less second, of more the least less the next.
    """

    def by(all_: Column, names: list[str], plain: bool) -> Column:
        kg = lambda s: F.when(s["per_kg"] > 0, s["per_kg"]).when(present(s["shelf"]) & present(s["pack_kg"]), r2(s["shelf"] / s["pack_kg"]))

        def chosen(usable: Column) -> Column:
            every = lambda rule: F.forall(usable, lambda s: F.coalesce(rule(s), F.lit(False)))
            kgs = F.transform(usable, lambda s: s["pack_kg"])
            packs = F.size(F.filter(usable, lambda s: present(s["pack_kg"]) & present(s["shelf"])))
            alike = (packs == F.size(usable)) & F.coalesce(similar(F.array_min(kgs), F.array_max(kgs)), F.lit(False))
            told = lambda basis, label, value: F.struct(F.lit(basis).alias("basis"), label.alias("label"), F.transform(all_, lambda s: F.when(s["ok"], value(s))).alias("v"))
            return F.when(F.size(usable) >= 2, F.when(every(lambda s: s["egg"] & present(s["per_each"])), told("per_egg", F.lit("per_egg"), lambda s: s["per_each"]))
                .when(alike, told("per_pack", F.lit("packs_alike"), lambda s: s["shelf"]))
                .when(every(lambda s: kg(s) > 0), told("per_100g", F.when(packs >= 2, "different_packs").otherwise("per_100g"), lambda s: r2(kg(s) / 10)))
                .when(every(lambda s: s["line"] > 0), told("per_pack", F.lit("per_line"), lambda s: s["line"])))

        def ranked(x: Column) -> Column:
            delta = r2(F.get(x["v"], F.lit(0)) - F.get(x["v"], F.lit(1))) if plain else spread_at(x["v"])
            return F.when(x.isNotNull(), F.struct(x["basis"].alias("basis"), x["label"].alias("label"), cheapest_at(x["v"], names).alias("cheaper"), delta.alias("delta")))

        return let(let(F.filter(all_, lambda s: s["ok"]), chosen), ranked)

    none = F.struct(F.lit("incomparable").alias("basis"), F.lit("no_price").alias("label"), F.lit("incomplete").alias("cheaper"), F.lit(None).cast("double").alias("delta")).cast(_NEITHER)
    more = F.exists(F.slice(sides, 3, len(stores)), lambda s: s["ok"])
    return F.coalesce(F.when(more, by(sides, stores, False)), by(F.slice(sides, 1, 2), stores[:2], True), none)


def fair_checkouts(lines: Column, stores: list[str], stock_up: Column, most: Column) -> Column:
    """struct<cheaper, delta> of what is paid: array of struct<valid, cost, got, unit, pack, price>, one for each store.

    Exact needs compare as they are. Of stock the purchase with the least price of a unit wins, and the others count
    with the packs that give as much, as far as `most` allows; those sold loose have no packs and drop out unless they win.
    """
    good = lambda x: F.coalesce(x["valid"] & x["cost"].isNotNull(), F.lit(False))
    rank = lambda x, i: F.when(good(x), F.struct(F.coalesce(x["unit"], F.lit(float("inf"))).alias("unit"), x["cost"].alias("cost"), i.alias("i"), x["got"].alias("got")))

    def stock(won: Column) -> Column:
        def cost(x: Column, i: Column) -> Column:
            packs = F.ceil(won["got"] / x["pack"] - 1e-9)
            as_much = F.when(packs * x["pack"] - 1e-6 <= most, r2(packs * x["price"]))
            return F.when(F.coalesce(x["valid"], F.lit(False)) & x["pack"].isNotNull(), as_much).when(won["i"] == i, x["cost"])

        return F.transform(lines, cost)

    paid = F.transform(lines, lambda x: F.when(good(x), x["cost"]))
    counted = F.when(stock_up, let(F.array_min(F.array_compact(F.transform(lines, rank))), stock)).otherwise(paid)
    values = F.when(F.size(F.array_compact(paid)) >= 2, counted).otherwise(F.expr("cast(array() as array<double>)"))
    return let(values, lambda v: F.struct(cheapest_at(v, stores).alias("cheaper"), spread_at(v).alias("delta")))


def compare_rows(items: DataFrame, offers: DataFrame, stores: list[str]) -> DataFrame:
    """One row an item: needed grams, cheaper, delta, basis, label, match_kind, requested, requested_unit and, by store, basket, packs, got, extra and status.

    items: item, weighed (sold by weight), produce (has prices by weight), cheapest (mode; else a preferred product), egg, supplies, rejected (its link is
    ruled out), strategy, unit, default_amount, maximum, percent, each_grams, grams, qty, requested, preferred_id, upc_hit. offers: item, store and
    OFFER: ok says that sanity lets the price count, identity_reason why it is another product (null if it is the one), status what stands
    there without a purchase. An offer counts with a product_id and a price; of several in one store the one of the smallest product_id. Null flags are false,
    null amounts unset; items without offers are incomplete; other columns are ignored. One aggregation by item, combined before the shuffle.
    """
    no = F.lit(False)
    flags = ["weighed", "produce", "cheapest", "egg", "supplies", "rejected", "upc_hit"]
    rest = ["strategy", "unit", "default_amount", "maximum", "percent", "each_grams", "grams", "qty", "requested", "preferred_id"]
    settings = items.select("item", *[F.coalesce(F.col(c), no).alias(c) for c in flags], *rest)
    usable = offers.where("product_id <> '' and price > 0").select("item", "store", *OFFER)
    facts = offer_facts(usable.join(settings.select("item", "weighed", "produce", "egg", "unit", "each_grams"), "item"))
    wide = facts.groupBy("item").agg(F.array(*[F.min_by("facts", F.when(F.col("store") == s, F.col("product_id"))) for s in stores]).alias("o"))
    rows = settings.join(wide, "item", "left")
    kind = facts.schema["facts"].dataType.simpleString()
    rows = rows.withColumn("o", F.coalesce("o", F.array(*[F.lit(None).cast(kind) for _ in stores])))

    qty = F.greatest(F.floor(F.coalesce(F.nullif("qty", F.lit(0.0)), F.lit(1.0)) + 0.5), F.lit(1)).cast("double")
    rows = rows.withColumn("qty", qty)
    cover = shared_cover(F.transform("o", lambda x: x["kg"]), F.col("qty"))
    need = needed_grams(F.col("weighed"), F.col("cheapest"), F.col("egg"), F.col("supplies"), F.col("grams"), cover)
    rows = rows.withColumn("need", need)
    needed, egg, weighed, unit = F.col("need.grams"), F.col("egg"), F.col("weighed"), F.col("unit")
    active = F.coalesce(needed > 0, no) & ~weighed
    packs = F.when(weighed | active, F.lit(1.0)).otherwise(F.col("qty"))
    requested = (
        F.when(F.col("requested") > 0, F.col("requested")).when((unit == "g") & (needed > 0), needed).when((unit == "kg") & (needed > 0), needed / 1000)
        .when(units.dimension_of(unit) != "count", F.col("default_amount")).otherwise(packs)
    )
    eggs = F.greatest(F.floor(F.coalesce(F.nullif("requested", F.lit(0.0)), F.col("qty")) + 0.5), F.lit(1))
    rows = rows.withColumns({"active": active, "packs": packs, "amount": requested.cast("double"), "times": F.when(egg, eggs).when(weighed, needed / 1000).otherwise(packs)})
    percent = F.coalesce("percent", F.lit(15.0))

    def told(x: Column) -> Column:
        """All that one store's offer says about the amount: its side of the comparison, plan by weight and purchase."""
        side = F.struct(
            F.coalesce(x["ok"], no).alias("ok"), x["price"].alias("shelf"), F.when(x["ok"], r2(x["price"] * F.col("times"))).alias("line"), x["per_kg"].alias("per_kg"),
            x["per_each"].alias("per_each"), x["pack_kg"].alias("pack_kg"), egg.alias("egg"),
        )
        known = x.isNotNull() & x["reason"].isNull()
        bought = F.when(known, costing.purchase(x["buy"], x["price"], F.col("strategy"), F.col("amount"), F.col("maximum"), percent))
        return F.struct(side.cast(SIDE).alias("side"), known.alias("known"), weight_plan(x, needed).alias("plan"), bought.alias("bought"))

    rows = rows.withColumn("t", F.transform("o", told))
    rows = rows.withColumn("by_weight", F.col("active") & ~egg & F.exists("t", lambda x: x["plan"].isNotNull()))
    by_weight = F.col("by_weight")

    def shown(x: Column, o: Column) -> Column:
        plan, bought = x["plan"], x["bought"]
        planned = by_weight & plan.isNotNull() & x["known"]
        cost = F.when(by_weight, F.when(x["known"], plan["total"])).otherwise(F.when(bought["valid"], bought["total"]))
        status = F.when(planned | F.coalesce(bought["valid"], no), "ok").otherwise(F.coalesce(o["reason"], bought["reason"], o["status"], F.lit("no_match")))
        return F.struct(
            cost.alias("basket"), F.when(planned, plan["packs"]).otherwise(bought["packs"]).alias("packs"), F.when(planned, plan["got"]).otherwise(bought["got"]).alias("got"),
            F.when(planned, F.greatest(plan["got"] - needed, F.lit(0.0))).otherwise(bought["extra"]).alias("extra"), status.alias("status"),
            F.struct(
                F.coalesce(bought["valid"], no).alias("valid"), cost.alias("cost"), bought["got"].alias("got"), bought["unit"].alias("unit"),
                F.when(bought["sale_mode"] != "loose_weight", o["buy"]["pack"]).alias("pack"), o["price"].alias("price"),
            ).alias("line"),
        )

    rows = rows.withColumns({
        "shown": F.zip_with("t", "o", shown), "fair": fair_sides(F.transform("t", lambda x: x["side"]), stores),
        "totals": F.transform("t", lambda x: F.when(x["side"]["ok"], x["plan"]["total"])),
    })
    stock_up = F.col("strategy") == "stock_up"
    most = F.coalesce(F.col("maximum"), F.col("amount") * (1 + percent / 100))
    result = lambda basis, label, cheaper, delta: F.struct(basis.alias("basis"), label.alias("label"), cheaper.alias("cheaper"), delta.alias("delta"))
    rejected = result(F.lit("incomparable"), F.lit("different_products"), F.lit("incomplete"), F.lit(None).cast("double"))
    weight = result(
        F.lit("needed_weight"), F.when(F.col("need.shared"), "grams_of_different_packs").otherwise("needed_amount"), cheapest_at(F.col("totals"), stores), spread_at(F.col("totals"))
    )
    paid = let(
        fair_checkouts(F.transform("shown", lambda x: x["line"]), stores, stock_up, most),
        lambda c: result(F.when(stock_up, "needed_weight").otherwise(F.col("fair.basis")), F.when(stock_up, "stock_up").otherwise("checkout"), c["cheaper"], c["delta"]),
    )
    first_id = F.coalesce(*[F.get("o", F.lit(i))["product_id"] for i in range(min(3, len(stores)))])
    match_kind = F.when(F.col("upc_hit"), "upc").when(F.col("preferred_id") == first_id, "preferred_sku").when(F.col("cheapest"), "category_cheapest").otherwise("fuzzy")
    rows = rows.withColumns({"final": F.when(F.col("rejected") & ~F.col("cheapest"), rejected).when(by_weight, weight).otherwise(paid), "match_kind": match_kind})
    return rows.select(
        "item", F.coalesce(needed, F.col("grams")).alias("grams"), F.col("packs").alias("qty"), "match_kind", "final.basis", "final.label", "final.cheaper", "final.delta",
        F.when(F.col("active"), needed).otherwise(F.col("amount")).alias("requested"), F.when(F.col("active"), F.lit("g")).otherwise(unit).alias("requested_unit"),
        *[F.get("shown", F.lit(i))[c].alias(f"{c}_{s}") for i, s in enumerate(stores) for c in ("basket", "packs", "got", "extra", "status")],
    )
