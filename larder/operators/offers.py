"""Single offers: filters by words, match to a query, sanity, sales, best and cheapest of a group."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import units
from larder.functions.expr import let
from larder.functions.money import TIE, packs_needed, r2

#: Words of queries: left out, of no weight for identity, and never wanted unless asked for; fixed values.
STOP = ["the", "and", "or", "a", "an", "of", "for", "with", "pack", "pk", "size", "bunch", "no", "oj"]
SOFT = [
    "4l", "3l", "2l", "1l", "4", "3", "2", "1", "l", "kg", "g", "ml", "oz", "ounce", "ounces", "fl", "floz", "lb", "lbs", "ct", "count", "dozen", "doz", "12", "ea", "each",
    "1kg", "500g", "1000g", "litre", "liter", "litres", "liters", "gram", "grams", "percent", "pct", "pure", "premium", "original", "classic", "fresh", "pint", "clamshell",
]
REJECT = [
    "pump", "dessert", "dog", "cat", "treat", "shampoo", "toy", "potter", "dragon", "harry", "medela", "norbert", "hagrid", "easter", "fillable", "party", "powder", "chocolate",
]
#: Keywords that are only a size, and sizes and counts within a text; fixed values.
SIZE_KEYWORD = r"^\d+([.]\d+)?\s*(l|lt|ml|kg|g|oz|fl\s*oz|lb|lbs|ct|pk|pack|dozen|doz)$|^\d+\s*x\s*\d+([.]\d+)?$|^\d+([.]\d+)?$|^$"
SIZE_NOISE, COUNT_NOISE = r"(?i)\b\d+([.,]\d+)?\s*(l|lt|ml|kg|g|oz|lb|lbs|ct|pk|pack|dozen|doz)\b", r"(?i)\b\d+\s*x\s*\d+\b"
#: The smallest share of an expected pack that compares, and the most packs that stand for one; fixed values.
LEAST_RATIO, MOST_COMPOSED = 0.35, 6
SHELF_HOURS = 24.0
_NO_WORDS = "cast(array() as array<string>)"


def query_tokens(text: Column) -> Column:
    """Words in order, percent signs as words, stop words left out."""
    t = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("%"), F.lit(" percent ")), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(STOP))


def is_soft(word: Column) -> Column:
    """Sizes, units, marketing, numbers and words of one or two letters."""
    return word.isin(SOFT) | word.rlike(r"^\d") | (F.length(word) <= 2)


def token_hit(word: Column, hay: Column) -> Column:
    """Whether a word of hay is the word or, from four letters on, one begins the other."""
    return F.exists(hay, lambda n: (n == word) | ((F.length(word) >= 4) & (n.startswith(word) | word.startswith(n))))


def score_match(name: Column, brand: Column, size: Column, price: Column, exact: Column, estimated: Column, query: Column, target_kg: Column | None = None) -> Column:
    """Match of an offer to a query, higher is better; null is no match.

    Every word of the query that tells products apart must be there, no unwanted word may be, and the price must be
    positive. 10, and 1 if exact, the share of soft words, the fit of the mass, less 1 above a price of 40.
    """
    asked, own = query_tokens(query), query_tokens(F.concat_ws(" ", F.coalesce(brand, F.lit("")), name))
    core, soft = F.filter(asked, lambda w: ~is_soft(w)), F.filter(asked, is_soft)
    joined = F.array_join(own, " ")
    unwanted = F.exists(F.array(*map(F.lit, REJECT)), lambda w: joined.contains(w) & ~F.array_contains(core, w))
    sizes = query_tokens(size)
    hits = F.size(F.filter(soft, lambda w: token_hit(w, own) | token_hit(w, sizes)))
    mass = F.coalesce(units.parse_mass(size), units.parse_mass(name))["kg"]
    fit = F.lit(0) if target_kg is None else units.mass_match_score(mass, target_kg)
    score = 10 + F.when(exact, 1).otherwise(0) + F.when(F.size(soft) > 0, hits / F.size(soft)).otherwise(0.0) + fit - F.when(price > 40, 1).otherwise(0)
    ok = (F.size(core) > 0) & (F.size(own) > 0) & ~unwanted & F.forall(core, lambda w: token_hit(w, own)) & (price > 0) & ~(estimated & (price >= 100))
    return F.when(ok, score.cast("double"))


def name_has(hay: Column, needle: Column) -> Column:
    """Whether a text has a phrase, or a word on its own with or without a plural ending."""
    n, h = F.trim(F.lower(needle)), F.lower(hay)
    escaped = F.regexp_replace(n, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    word = F.regexp_like(h, F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit("(?:es|s)?([^a-z0-9]|$)")))
    return F.coalesce((n != "") & F.when(n.contains(" "), h.contains(n)).otherwise(word), F.lit(False))


def name_has_phrase(hay: Column, needle: Column, split: Column) -> Column:
    """As name_has; where `split` holds, also if the words of a phrase stand anywhere."""
    parts = F.filter(F.split(F.trim(F.lower(needle)), r"\s+"), lambda p: p != "")
    return name_has(hay, needle) | (F.coalesce(split, F.lit(False)) & (F.size(parts) >= 2) & F.forall(parts, lambda p: name_has(hay, p)))


def is_size_keyword(raw: Column) -> Column:
    """Whether a keyword is only a size or a count."""
    t = F.replace(F.lower(F.trim(raw)), F.lit(","), F.lit("."))
    return t.rlike(SIZE_KEYWORD)


def identity_keywords(words: Column) -> Column:
    """Trimmed keywords without sizes and empty ones."""
    return F.filter(F.transform(F.coalesce(words, F.expr(_NO_WORDS)), lambda w: F.trim(w)), lambda w: ~is_size_keyword(w))


def strip_pack_noise(text: Column) -> Column:
    """Without sizes and N x M."""
    t = F.regexp_replace(text, SIZE_NOISE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, COUNT_NOISE, " "), r"\s+", " "))


def filter_reason(hay: Column, banned: Column, need_all: Column, need_any: Column, split: Column, form: Column | None = None) -> Column:
    """The first rule that an offer's text breaks, null if none: its form, a banned word, a word it must have, one of some.

    banned, need_all and need_any: arrays of words and phrases, null for none; split: whether phrases may be torn apart.
    """
    none = F.expr(_NO_WORDS)
    bad = F.get(F.filter(F.coalesce(banned, none), lambda w: (w != "") & name_has(hay, w)), F.lit(0))
    missing = F.get(F.filter(identity_keywords(need_all), lambda w: ~name_has_phrase(hay, w, split)), F.lit(0))
    some = identity_keywords(need_any)
    lacks = (F.size(some) > 0) & ~F.exists(some, lambda w: name_has_phrase(hay, w, split))
    rules = [F.concat(F.lit("mustNotInclude:"), bad), F.concat(F.lit("mustIncludeAll:"), missing), F.when(lacks, "mustIncludeAny")]
    return F.coalesce(*([form] if form is not None else []), *rules)


def form_reason(offers: DataFrame, rules: DataFrame, hay: str = "hay") -> DataFrame:
    """Adds `form`: the reason of the first rule of an offer's item that its text breaks, null if none.

    offers: item and the text `hay`. rules: item, ord, kind, pattern, reason, by which a text must have
    the pattern (kind require) or must not (kind ban). All rules of an item travel as one array, so offers are not multiplied.
    """
    listed = rules.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "pattern", "reason"))).alias("rules__"))
    broken = F.filter("rules__", lambda r: F.regexp_like(F.lower(F.coalesce(F.col(hay), F.lit(""))), r["pattern"]) == (r["kind"] == "ban"))
    return offers.join(listed, "item", "left").withColumn("form", F.get(broken, F.lit(0))["reason"]).drop("rules__")


def comparable_price(price: Column, text: Column, eggs: Column) -> Column:
    """Price of a carton where a case of cartons is sold."""
    outer = F.coalesce(F.greatest(units.count_pack(text)["outer"], F.lit(1)), F.lit(1))
    return F.when(eggs & (price > 0), price / outer).otherwise(price)


def compose_count(pack_kg: Column, need_kg: Column) -> Column:
    return F.when((pack_kg > 0) & (need_kg > 0), packs_needed(need_kg, pack_kg)).otherwise(0)


def comparable_pack(pack_kg: Column, expected_kg: Column) -> Column:
    """At least 35 % of what is expected; unknown ones pass."""
    return F.coalesce(~((expected_kg > 0) & (pack_kg > 0)) | (pack_kg >= expected_kg * LEAST_RATIO), F.lit(True))


def can_compose(pack_kg: Column, need_kg: Column, most: int = MOST_COMPOSED) -> Column:
    n = compose_count(pack_kg, need_kg)
    return comparable_pack(pack_kg, need_kg) | ((pack_kg + 1e-9 < need_kg) & n.between(2, most))


def sanity(offer: dict[str, Column], expected_kg: Column, compose: Column, least: Column, most: Column, jug: Column, eggs: Column, hours: float = SHELF_HOURS) -> Column:
    """struct<ok, status, pack_kg>, the first that holds: rejected without a price; wrong_pack below the least price (of all packs that
    make up the expected one); rejected above the most; wrong_size if more than six packs or a mini; wrong_pack for a jug under
    400 g; stale, which is ok; else ok.

    offer: name, size, price, unit_price (of 100 ml), age_hours.
    """
    text = F.concat_ws(" ", offer["name"], offer["size"])
    mass = F.coalesce(units.parse_mass(offer["size"]), units.parse_mass(offer["name"]))["kg"]
    kg = F.coalesce(mass, units.infer_pack_kg(offer["price"], offer["unit_price"], F.lit("")))
    facts = F.struct(kg.alias("kg"), comparable_price(offer["price"], text, eggs).alias("price"))

    def ladder(x: Column) -> Column:
        composing = F.coalesce(compose & (x["kg"] > 0) & (x["kg"] + 1e-9 < expected_kg), F.lit(False))
        n = F.when(composing, compose_count(x["kg"], expected_kg)).otherwise(1)
        wrong_size = F.when(composing, n > MOST_COMPOSED).otherwise(~comparable_pack(x["kg"], expected_kg))
        status = (
            F.when(~F.coalesce(offer["price"] > 0, F.lit(False)), "rejected").when(F.when(n >= 2, x["price"] * n).otherwise(x["price"]) < least, "wrong_pack")
            .when(x["price"] > most, "rejected").when(wrong_size, "wrong_size").when(jug & (x["kg"] < 0.4), "wrong_pack").when(offer["age_hours"] > hours, "stale").otherwise("ok")
        )
        return let(status, lambda s: F.struct(s.isin("ok", "stale").alias("ok"), s.alias("status"), x["kg"].alias("pack_kg")))

    return let(facts, ladder)


def on_shelf(availability: Column) -> Column:
    """Only what is out of stock is not; unknown is."""
    return F.coalesce(availability != "out_of_stock", F.lit(True))


def was_price(price: Column, *before: Column) -> Column:
    """The first earlier price above the present one."""
    return F.get(F.filter(F.array(*before), lambda c: c > price + TIE), F.lit(0))


def is_sale(price: Column, before: Column, flag: Column) -> Column:
    return F.coalesce((price > 0) & (F.coalesce(before > price + TIE, F.lit(False)) | F.coalesce(flag, F.lit(False))), F.lit(False))


def sale_saving(price: Column, before: Column) -> Column:
    return F.when((price > 0) & (before > price + TIE), r2(before - price))


def cheaper_sales(offers: DataFrame) -> DataFrame:
    """The offers on sale that are also the cheapest of their item, or within half a cent. offers: item, store, price, was, flag."""
    least = offers.where("price > 0").groupBy("item").agg(F.min("price").alias("least__"))
    found = offers.join(least, "item").where((F.col("price") > 0) & (F.col("price") <= F.col("least__") + TIE)).drop("least__")
    return found.where(is_sale(F.col("price"), F.col("was"), F.col("flag")))


def fair_unit(price: Column, kg: Column) -> Column:
    """Price of a kilogram, or of the pack where its mass is not known; the two share one order."""
    return F.when(price > 0, F.when(kg > 0, price / kg).otherwise(price))


def cheapest(offers: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """Of each key the offer with the least value, the first by `order` among equals; null values are left out."""
    return offers.withColumn("value__", value).where("value__ is not null").groupBy(key).agg(F.min_by(F.struct(*offers.columns), F.struct("value__", order)).alias("m")).select("m.*")


def best_match(offers: DataFrame, key: str, score: Column, preferred: Column, order: str) -> DataFrame:
    """Of each key the preferred offer if it is there, else the one of the highest score, the first by `order` among equals; null scores never win."""
    other = ~F.coalesce(preferred, F.lit(False))
    rank = F.struct(other.alias("other"), F.when(other, -score).alias("score"), F.col(order))  # of several preferred ones the first
    found = offers.withColumn("rank__", rank).where(F.coalesce(preferred, F.lit(False)) | score.isNotNull())
    return found.groupBy(key).agg(F.min_by(F.struct(*offers.columns), "rank__").alias("m")).select("m.*")


def map_availability(raw: Column) -> Column:
    """in_stock, out_of_stock or unknown, from a word or flag that says a thing is available."""
    t = F.regexp_replace(F.trim(F.lower(raw)), r"[\s-]+", "_")
    return (
        F.when(t.contains("out_of_stock") | t.contains("unavailable") | t.isin("false", "out"), "out_of_stock")
        .when(t.contains("in_stock") | t.contains("available") | t.isin("true", "ok"), "in_stock").otherwise("unknown")
    )


def parse_money(raw: Column) -> Column:
    """The number that a text of digits, dots and anything else begins with."""
    return F.regexp_extract(F.regexp_replace(raw, r"[^0-9.]", ""), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def delivery_spread(shelf: Column, delivery: Column) -> Column:
    """struct<spread_pct, hint> of a delivery price over the shelf price; it never stands for a shelf price."""
    known = (shelf > 0) & (delivery > 0)
    pct = F.when(known, F.floor((delivery - shelf) / shelf * 1000 + 0.5) / 10)
    hint = F.when(pct > 5, "delivery_higher").when(pct < -5, "delivery_lower").when(pct.isNotNull(), "similar").otherwise("incomplete")
    return F.struct(pct.alias("spread_pct"), hint.alias("hint"))


def image_url(raw: Column) -> Column:
    """A url with a scheme, https where there is none; null for anything else."""
    t = F.trim(raw)
    return F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.rlike("(?i)^https?://"), t)


def barcodes(text: Column) -> Column:
    """All barcodes that a text names, without leading zeros, each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{8,14})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.coalesce(F.nullif(F.regexp_replace(d, "^0+", ""), F.lit("")), d)))


def merge_keywords(*lists: Column) -> Column:
    """Trimmed words of all lists in order, each once whatever its case, in its first spelling; null if none."""
    none = F.expr(_NO_WORDS)
    every = F.filter(F.transform(F.concat(*[F.coalesce(x, none) for x in lists]), lambda w: F.trim(w)), lambda w: w != "")
    low = F.transform(every, F.lower)
    kept = F.filter(every, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return F.when(F.size(kept) > 0, kept)


def search_score(label: Column, item_id: Column, query: str) -> Column:
    """100 the label itself, 80 its beginning, 60 within it, 40 within the id, else 20; 0 for an empty query."""
    q, low = query.strip().lower(), F.lower(label)
    if not q:
        return F.lit(0)
    return F.when(low == q, 100).when(low.startswith(q), 80).when(low.contains(q), 60).when(F.replace(item_id, F.lit("_"), F.lit(" ")).contains(q), 40).otherwise(20)


def search_catalogue(items: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """The best `limit` items (id, label, hay) for a query of two letters or more: the limit is the operator's report.

    An item matches with the query, with all its words of two letters or more, or with all its words in any form.
    """
    q = re.sub(r"\s+", " ", query.strip())
    if len(q) < 2:
        return items.limit(0)
    parts = [p for p in q.lower().split() if len(p) >= 2]
    every = F.forall(F.array(*map(F.lit, parts or [""])), lambda p: F.col("hay").contains(p)) & F.lit(len(parts) > 1)
    found = items.where(F.col("hay").contains(q.lower()) | every | name_has_phrase(F.col("hay"), F.lit(q.lower()), F.lit(True)))
    return found.withColumn("score", search_score(F.col("label"), F.col("id"), q)).orderBy(F.desc("score"), "label", "id").limit(limit)
