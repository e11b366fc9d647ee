"""Which offer of a store stands for an item: the locked one, the one for a needed weight, or one that passes the filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.identity import skus_equivalent
from larder.operators.offers import fair_unit, on_shelf

RESULT = ["product_id", "price", "fair__"]


def is_case_pack(name: Column) -> Column:
    """A warehouse case: the word, or a count times a size."""
    return F.coalesce(name.rlike(r"(?i)\bcase\b|\b\d+\s*x\s*\d+"), F.lit(False))


def matches_sku(product_id: Column, url: Column, sku: Column) -> Column:
    """Whether an offer is that of a SKU: the same id, an address that holds it, or a number one off."""
    return F.coalesce((sku != "") & (skus_equivalent(product_id, sku) | F.coalesce(F.contains(url, sku), F.lit(False))), F.lit(False))


def is_locked(sku: Column, verified: Column, decision: Column, kind: Column, skipped: Column) -> Column:
    """Whether a mapping fixes the SKU: verified, or linked automatically by identity or without a new match, and not under review."""
    no = F.lit(False)
    linked = F.coalesce(decision == "auto_linked", no) & (F.coalesce(kind == "identity", no) | F.coalesce(skipped, no))
    return F.coalesce(sku != "", no) & ~F.coalesce(decision == "needs_review", no) & (F.coalesce(verified, no) | linked)


def candidates(offers: DataFrame) -> DataFrame:
    """The offers of each item, of one product the first by ord; those without a product_id are none."""
    named = offers.where("item is not null and product_id <> ''")
    return named.groupBy("item", "product_id").agg(F.min_by(F.struct(*named.columns), "ord").alias("m")).select("m.*")


def _pick(when: Column, *order: str) -> Column:
    return F.min_by(F.struct(*RESULT), F.when(when, F.struct(*order, "ord")))


def _pool(passes: Column, name: str, *order: str, also: Column | None = None) -> Column:
    """The first by `order` among the offers that pass, single packs only where there is one."""
    single, wanted = passes & ~F.col("case__"), F.lit(True) if also is None else also
    return F.when(F.bool_or(single), _pick(single & wanted, *order)).otherwise(_pick(passes & wanted, *order)).alias(name)


def resolve(offers: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """One row an item: item, product_id, price, reason, detail.

    offers: item, ord (0 for the listed one, then its alternates), product_id, url, name, price, kg, availability,
    reason and alternate_reason (why it fails the filters of the item and of its named alternate, null if it passes), need (any
    value that ranks it for a needed weight, the least first, null if it is no candidate) and cover (total of a valid purchase).
    items: item, cheapest, skip_lock (a cheaper equal may replace a locked SKU), alternate (has a named second product),
    use_if_cheaper, keep. links: item, sku, verified, decision, kind, skipped, at most one an item.

    In this order: the locked SKU on the shelf that passes; in cheapest mode the one for the needed weight, then the least fair
    unit; else the least cover, then the first that passes. A named alternate replaces a missing one, or a dearer one. Nulls are
    false, an item without offers has none, equal ranks go to the smaller ord. Two aggregations by item, combined before the shuffle.
    """
    no = F.lit(False)
    flag = lambda c: F.coalesce(F.col(c), no).alias(c)
    settings = items.select("item", *[flag(c) for c in ("cheapest", "skip_lock", "alternate", "keep")], F.coalesce("use_if_cheaper", F.lit(True)).alias("use_if_cheaper"))
    locks = links.where(is_locked(*[F.col(c) for c in ("sku", "verified", "decision", "kind", "skipped")])).select("item", "sku")
    rows = (
        candidates(offers).join(settings.join(locks, "item", "left"), "item")
        .withColumn("sku", F.when(~(F.col("cheapest") & F.col("skip_lock")), F.col("sku")))
        .withColumn("fair__", fair_unit(F.col("price"), F.col("kg"))).withColumn("case__", is_case_pack(F.col("name"))).withColumn("shelf__", on_shelf(F.col("availability")))
    )
    passes = F.col("shelf__") & F.col("reason").isNull()
    facts = rows.groupBy("item").agg(
        F.min_by(F.struct(*RESULT, "shelf__", "reason", "sku"), F.when(matches_sku(F.col("product_id"), F.col("url"), F.col("sku")), F.col("ord"))).alias("hit"),
        F.min_by(F.struct(*RESULT, "shelf__", "reason"), F.when(F.col("ord") == 0, F.col("ord"))).alias("listed"),
        _pick(F.col("shelf__") & F.col("need").isNotNull(), "need").alias("need"), _pool(passes, "fair", "fair__", also=F.col("fair__").isNotNull()),
        _pool(passes, "cover", "cover", also=F.col("cover").isNotNull()), _pool(passes, "first"),
    )
    locked = F.coalesce(F.col("hit.shelf__") & F.col("hit.reason").isNull(), no)
    none = F.lit(None).cast(facts.schema["first"].dataType)
    found = settings.join(facts, "item", "left").withColumn(
        "way", F.when(locked, F.when(F.col("hit.product_id") == F.col("hit.sku"), "mapped_sku").otherwise("mapped_sku_alias"))
        .when(F.col("cheapest") & F.col("need").isNotNull(), "need").when(F.col("first").isNull(), "none")
        .when(F.col("cheapest") & F.col("fair").isNotNull(), "fair").when(~F.col("cheapest") & F.col("cover").isNotNull(), "cover").otherwise("first"),
    ).withColumn(
        "main", F.when(F.col("way").isin("mapped_sku", "mapped_sku_alias"), F.struct(*[F.col(f"hit.{c}").alias(c) for c in RESULT]))
        .when(F.col("way") == "need", F.col("need")).when(F.col("way") == "fair", F.col("fair")).when(F.col("way") == "cover", F.col("cover"))
        .when(F.col("way") == "first", F.col("first")).otherwise(none),
    )
    other = F.col("shelf__") & F.col("alternate_reason").isNull()
    seconds = (
        rows.where("alternate").join(found.select("item", F.col("main.product_id").alias("main__")), "item").groupBy("item")
        .agg(_pool(other, "second", "fair__", also=F.col("fair__").isNotNull() & ~F.col("product_id").eqNullSafe(F.col("main__"))))
    )
    cheaper = F.col("use_if_cheaper") & ~F.col("keep") & F.coalesce(F.col("second.fair__") < F.col("main.fair__"), F.col("main.fair__").isNull())
    swapped = F.col("second").isNotNull() & ~F.col("way").isin("need", "fair") & (F.col("main").isNull() | cheaper)
    out = found.join(seconds, "item", "left").withColumn("swap", F.coalesce(swapped, no)).withColumn("chosen", F.when(F.col("swap"), F.col("second")).otherwise(F.col("main")))
    by_place = F.when(F.col("chosen.product_id") == F.col("listed.product_id"), "catalog").otherwise("filtered_alternate")
    gone = F.col("listed").isNotNull() & ~F.col("listed.shelf__")
    reason = (
        F.when(F.col("swap"), by_place).when(F.col("way").startswith("mapped"), F.col("way")).when(F.col("chosen").isNotNull(), by_place)
        .when(F.col("listed").isNull() | gone, "no_offer").otherwise("rejected_filter")
    )
    detail = (
        F.when(F.col("swap"), F.when(F.col("main").isNull(), "alternate_fallback").otherwise("alternate_cheaper")).when(F.col("way").startswith("mapped"), F.col("hit.sku"))
        .when(F.col("chosen").isNotNull(), F.when(F.col("way").isin("need", "cover"), F.col("way")))
        .when(gone, "not_on_shelf").when(F.col("listed").isNotNull(), F.coalesce(F.col("listed.reason"), F.lit("filter")))
    )
    return out.select("item", "chosen.product_id", "chosen.price", reason.alias("reason"), detail.alias("detail"))


def refresh_sku(offers: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(item, sku) whose price is to be fetched again, one row for each item of known.

    The locked SKU, else the confirmed one, else the first priced offer on the shelf that passes, else the preferred one.
    known: item, confirmed, preferred. Others as in resolve.
    """
    locks = links.where(is_locked(*[F.col(c) for c in ("sku", "verified", "decision", "kind", "skipped")])).select("item", "sku")
    good = candidates(offers).where((F.col("price") > 0) & on_shelf(F.col("availability")) & F.col("reason").isNull())
    first = good.groupBy("item").agg(F.min_by("product_id", "ord").alias("first"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return known.join(locks, "item", "left").join(first, "item", "left").select("item", F.coalesce("sku", filled("confirmed"), "first", "preferred").alias("sku"))
