"""Whether an offer is the product: an ordered ladder whose rules on forms come as rows, compiled into one expression.

A confirmed SKU settles it at once. Exact products then go by barcode and preferred SKU, words, forms, size and brand; products that
anything equal may stand for go by words, forms and, if they are produce, the decision of operators.produce.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import units
from larder.operators.offers import can_compose, comparable_pack, identity_keywords, name_has, name_has_phrase
from larder.operators.produce import title_view


class Rule(NamedTuple):
    """An item whose `field` has `scope` does not take offers whose text has `pattern` and not `unless`."""

    field: str
    scope: str
    pattern: str
    unless: str | None
    reason: str


#: Forms that exclude each other, in the order in which they are asked; the patterns are fixed values.
FORMS = [
    Rule("fresh", "^yes$", r"\b(canned|can|tin|tinned)\b", None, "fresh_not_canned"),
    Rule("fresh", "^yes$", r"\b(sauce|paste|juice|ketchup|salsa|soup)\b", None, "fresh_not_processed"),
    Rule("fresh", "^yes$", r"\bfrozen\b", None, "fresh_not_frozen"),
    Rule("fresh_tomato", "^yes$", r"(?i)\b\d+(?:\.\d+)?\s*ml\b|\bunico\b", None, "fresh_not_canned"),
    Rule("fresh_item", "^tomato$", r"\bgrape\b", None, "fresh_not_grape"),
    Rule("frozen", "^yes$", r"\bfresh\b", r"\bfrozen\b", "frozen_not_fresh"),
    Rule("white_quinoa", "^yes$", r"\b(red|black|tricolor|tri-color)\b", r"\bwhite\b", "white_quinoa"),
    Rule("rectangular", "^yes$", r"\bround\b", None, "rectangular_not_round"),
    Rule("variant", "^round$", r"\brectang", None, "round_not_rectangular"),
]
#: Most packs that stand for a larger one of an exact product; fixed value.
MOST_PACKS = 4


def handle_text(product_id: Column, url: Column) -> Column:
    """Words of a hyphenated id and of the last part of an address that names a product."""
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    named = F.filter(parts, lambda p: ~p.isin("p", "en", "ip", "products") & ~p.rlike(r"^\d") & (F.length(p) > 2))
    leaf = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(parts, F.lit(-1)), F.lit(""))
    slug = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.regexp_replace(leaf, "[-_]+", " ")).otherwise(F.regexp_replace(text(url), "[-_/]+", " "))
    return F.trim(F.concat_ws(" ", F.regexp_replace(text(product_id), "[-_]+", " "), slug))


def form_reason(rules: Iterable[Rule], fields: dict[str, Column], text: Column) -> Column:
    """The reason of the first rule that an offer breaks, null if none."""
    made = []
    for r in rules:
        broken = fields[r.field].rlike(r.scope) & text.rlike(r.pattern)
        made.append(F.when(F.coalesce(broken if r.unless is None else broken & ~text.rlike(r.unless), F.lit(False)), r.reason))
    return F.coalesce(*made, F.lit(None).cast("string"))


def keyword_reason(text: Column, split: Column) -> Column:
    """The first of: a banned word, a word that all need, some that one needs, the type of the product; null if none is broken."""
    none = F.expr("cast(array() as array<string>)")
    banned = F.get(F.filter(F.coalesce("must_not", none), lambda w: (w != "") & name_has(text, w)), F.lit(0))
    missing = F.get(F.filter(identity_keywords(F.col("must_all")), lambda w: ~name_has_phrase(text, w, split)), F.lit(0))
    some = identity_keywords(F.col("must_any"))
    lacks = (F.size(some) > 0) & ~F.exists(some, lambda w: name_has_phrase(text, w, split))
    any_ = F.exists(F.coalesce("must_any", none), lambda w: name_has_phrase(text, w, split))
    untyped = (F.col("type") != "") & ~name_has_phrase(text, F.col("type"), split) & ~any_
    return F.coalesce(
        F.concat(F.lit("must_not:"), banned), F.concat(F.lit("must_all:"), missing), F.when(lacks, "must_any"), F.when(F.coalesce(untyped, F.lit(False)), F.concat(F.lit("type:"), F.col("type")))
    )


def size_reason(want: Column, got: Column, parsed_kg: Column) -> Column:
    """Whether volumes or masses that both sides print differ more than packs can make up for."""

    def apart(a: Column, b: Column) -> Column:
        smaller = a + 1e-6 < b
        return F.coalesce((a > 0) & (b > 0) & F.when(smaller, ~can_compose(a, b, MOST_PACKS)).otherwise(~comparable_pack(a, b)), F.lit(False))

    volume = apart(units.parse_volume_ml(got) / 1000, units.parse_volume_ml(want) / 1000)
    mass = apart(F.coalesce(units.parse_mass_kg(got), parsed_kg), units.parse_mass_kg(want))
    large = F.lower(got).rlike(r"\bextra\s*large\b") & F.lower(want).rlike(r"\blarge\b") & ~F.lower(want).rlike(r"\bextra\b")
    return F.when(volume, "size_ml").when(mass, "size_kg").when(F.coalesce(large, F.lit(False)), "large_not_extra_large")


def decide(offers: DataFrame, items: DataFrame, rules: Iterable[Rule] = FORMS) -> DataFrame:
    """(item, offer_id, ok, way, reason) of each offer: way says what settled it (confirmed, barcode, preferred, rules), reason why it is no match.

    items: item, label, exact (else an equivalent will do), category, form, type, variant, must_all, must_any, must_not, preferred_id, confirmed_id, barcode. offers: item,
    offer_id, product_id, name, brand, size, upc, url, parsed_kg, produce_reason (of operators.produce, for produce and frozen goods). Null texts and flags are empty and
    false, null arrays have no words; offers of unknown items have no row, repeated rows one each; other columns are ignored. No aggregation and one join.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    item_columns = ["item", "label", "exact", "category", "form", "type", "variant", "must_all", "must_any", "must_not", "preferred_id", "confirmed_id", "barcode"]
    offer_columns = ["item", "offer_id", "product_id", "name", "brand", "size", "upc", "url", "parsed_kg", "produce_reason"]
    rows = offers.select(*offer_columns).join(items.select(*item_columns), "item")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("product_id", "name", "brand", "size", "label", "category", "form", "type", "variant", "preferred_id", "confirmed_id", "barcode")})
    exact, produce = F.coalesce("exact", F.lit(False)), F.col("category").isin("produce", "frozen")
    text = F.lower(F.concat_ws(" ", "brand", "name", "size"))
    handle = handle_text(F.col("product_id"), F.col("url"))
    brand = F.when(F.lower("brand").rlike("^(fruits|vegetables)$"), "").otherwise(F.col("brand"))
    loose = F.concat_ws(" ", brand, F.when(produce, title_view(F.col("name"))).otherwise(F.col("name")), "size", handle)
    loose = F.when(loose.rlike(r"(?i)\b(iqf|alasko)\b") & ~loose.rlike(r"(?i)\bfrozen\b"), F.concat(loose, F.lit(" frozen"))).otherwise(loose)
    split = produce | ~exact
    rows = rows.withColumns({"text": text, "handle": handle, "split": split, "sought": F.when(split, loose).otherwise(text)})
    form = F.when(low("form") != "", low("form")).otherwise(low("category"))
    fresh = (form == "fresh") | (F.col("category") == "produce")
    id_ = F.col("item").cast("string")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    quinoa = (low("type") == "quinoa") | id_.contains("quinoa") | low("label").contains("quinoa")
    fields = {
        "fresh": yes(fresh), "fresh_tomato": yes(fresh & ((id_ == "tomato") | low("type").rlike(r"\btomato"))), "fresh_item": F.when(fresh, id_).otherwise(""),
        "frozen": yes((form == "frozen") | (F.col("category") == "frozen")), "white_quinoa": yes(quinoa & F.concat_ws(" ", low("label"), low("variant")).rlike(r"\bwhite\b")),
        "rectangular": yes((low("variant") == "rectangular") | low("label").rlike(r"\brect")), "variant": low("variant"), "id": id_, "label": low("label"), "type": low("type"),
        "category": low("category"),
    }
    confirmed = (F.col("confirmed_id") != "") & (F.col("product_id") != "") & (F.contains("product_id", F.col("confirmed_id")) | F.contains("confirmed_id", F.col("product_id")))
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "")
    barcode = (F.col("barcode") != "") & (F.coalesce("upc", F.lit("")) != "") & F.endswith(digits("upc"), F.substring(digits("barcode"), -12, 12))
    preferred = (F.col("preferred_id") != "") & (F.col("product_id") == F.col("preferred_id"))
    way = F.when(confirmed, "confirmed").when(exact & barcode, "barcode").when(exact & preferred, "preferred").otherwise("rules")
    rows = rows.withColumns({"way": way, "words": keyword_reason(F.col("sought"), F.col("split")), "forms": form_reason(rules, fields, F.concat_ws(" ", "text", F.lower("handle")))})
    first = F.get(F.split(F.trim("label"), r"\s+"), F.lit(0))
    known_brand = (F.length(first) > 2) & ~first.rlike(r"^\d") & (F.col("preferred_id") != "") & ~name_has(F.col("text"), F.lower(first))
    free_run = F.col("text").rlike(r"\bfree\s*run\b") & F.exists(F.coalesce("must_not", F.expr("cast(array() as array<string>)")), lambda w: w.rlike(r"(?i)free\s*run"))
    nothing = (F.col("preferred_id") == "") & (F.col("barcode") == "") & (F.col("confirmed_id") == "")
    kind = F.coalesce(F.nullif("type", F.lit("")), F.nullif(F.get("must_any", F.lit(0)), F.lit("")), F.lower(first))
    other = nothing & (kind != "") & ~name_has(F.col("text"), kind)
    size = size_reason(F.concat_ws(" ", "label", "preferred_id"), F.concat_ws(" ", "name", "size"), F.col("parsed_kg"))
    no = F.lit(False)
    strict = F.coalesce(size, F.when(F.coalesce(free_run, no), "free_run"), F.when(F.coalesce(known_brand, no), "other_brand"), F.when(F.coalesce(other, no), "other_type"))
    equal = F.when(produce & F.col("produce_reason").isNotNull(), "produce")
    reason = F.when(F.col("way") == "rules", F.coalesce("words", "forms", F.when(exact, strict).otherwise(equal)))
    return rows.withColumn("reason", reason).select("item", "offer_id", F.col("reason").isNull().alias("ok"), "way", "reason")
