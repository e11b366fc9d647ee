"""Units of measure, pack sizes, sale modes and unit prices.

Texts are read in lower case without commas. Amounts after a slash or a dollar sign
belong to prices. A null or empty text has no amount.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.expr import let
from larder.functions.money import r2

#: Kilograms of a pound. The unit-price parser takes a millilitre for a gram, the purchase parser keeps mass and volume apart. Fixed values.
KG_PER_LB = 0.45359237
KG = {"kg": 1.0, "g": 0.001, "gr": 0.001, "lb": KG_PER_LB, "lbs": KG_PER_LB, "oz": KG_PER_LB / 16, "ounce": KG_PER_LB / 16, "ounces": KG_PER_LB / 16}
ML = {"ml": 1.0, "l": 1000.0, "lt": 1000.0}
#: Patterns of sale modes; fixed values.
CASE = r"\b(cases?|crates?)\b"
MULTI_PACK = r"\b\d+\s*[x×]\s*\d+(?:\.\d+)?\s*(ea|pk|packs?|pints?|kg|g|lb|lbs|oz|ct|count|doz|dozen|ml|l|lt)\b"
CONTAINER = r"\b(packs?|bags?|clamshells?|cartons?|tubs?|jars?|bottles?|pouches?|sleeves?|trays?|baskets?|boxes?|punnets?)\b|sold in packs"
EACH = r"\b(1\s*ea|sold in singles|sold in single wrap)\b"
LOOSE = r"\b(per\s*kg|per\s*lb|\/\s*kg|\/\s*lb|loose|bulk|sold\s*by\s*(the\s*)?(kg|lb|weight))\b"
_NUMBER = r"(\d+(?:\.\d+)?)"
_UNITS = {"both": "|".join([*KG, *ML]), "mass": "|".join(KG), "volume": "|".join(ML)}


def _read(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(","), F.lit(""))


def _of(unit: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(unit))


def to_kg(value: Column, unit: Column, volume: bool = True) -> Column:
    """Null for a unit of another dimension; with volume a litre weighs a kilogram."""
    u = F.lower(unit)
    pounds = F.when(u.isin("oz", "ounce", "ounces"), value / 16).when(u.isin("lb", "lbs"), value) * KG_PER_LB
    small = ("g", "gr", "ml") if volume else ("g", "gr")
    return F.when(u.isin("kg", "l", "lt") if volume else u == "kg", value).when(u.isin(*small), value / 1000).otherwise(pounds)


def _amounts(t: Column, pattern: str) -> Column:
    """array<struct<value, unit>> of all matches."""
    return F.zip_with(
        F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)),
        lambda n, u: F.struct(n.cast("double").alias("value"), u.alias("unit")),
    )


def parse_mass(text: Column) -> Column:
    """struct<kg, value, unit> of the pack that a text names, null if none.

    N x M unit with N over 1 is N times as much; else the largest amount of which neither a
    dollar sign stands right before nor a slash among the three characters before, the first among
    equals; else the first amount joined to its unit, which may be a digit of a price and so 0.
    """
    units = _UNITS["both"]
    many, joined = rf"(\d+)\s*x\s*{_NUMBER}\s*({units})\b", rf"(?:^|[^$/]){_NUMBER}({units})\b"
    single = rf"(?<![\d/$])(?<!\d\.)(?<!/[\s\S])(?<!/[\s\S]{{2}}){_NUMBER}\s*({units})\b"
    made = lambda n, value, unit: F.struct((to_kg(value, unit) * n).alias("kg"), (value * n).alias("value"), unit.alias("unit"))

    def read(t: Column) -> Column:
        part = lambda p, i: F.regexp_extract(t, p, i)
        n = part(many, 1).try_cast("double")
        ranked = F.transform(_amounts(t, single), lambda a, i: F.struct(to_kg(a["value"], a["unit"]).alias("kg"), (-i).alias("at"), a["value"].alias("value"), a["unit"].alias("unit")))
        return (
            F.when((n > 1) & (part(many, 2).try_cast("double") > 0), made(n, part(many, 2).try_cast("double"), part(many, 3)))
            .when(t.rlike(single), let(F.array_max(ranked), lambda best: F.struct(best["kg"].alias("kg"), best["value"].alias("value"), best["unit"].alias("unit"))))
            .when(t.rlike(joined), made(F.lit(1.0), part(joined, 1).try_cast("double"), part(joined, 2)))
        )

    return let(_read(text), read)


def parse_amount(text: Column, kind: str = "mass") -> Column:
    """Kilograms (kind mass) or millilitres (kind volume) a text names, never of the other dimension; null if none or 0."""
    units = _UNITS[kind]
    amount = (lambda v, u: to_kg(v, u, False)) if kind == "mass" else (lambda v, u: v * _of(u, ML))
    few = units.replace("ounces|ounce|", "") if kind == "mass" else units
    many = rf"(\d+)\s*x\s*{_NUMBER}\s*({few})\b"
    single = rf"(?<![\d/$])(?<!\d\.){_NUMBER}\s*({units})\b"

    def read(t: Column) -> Column:
        times = F.regexp_extract(t, many, 1).try_cast("double") * amount(F.regexp_extract(t, many, 2).try_cast("double"), F.regexp_extract(t, many, 3))
        best = F.array_max(F.transform(_amounts(t, single), lambda a: amount(a["value"], a["unit"])))
        return F.when(F.regexp_like(t, F.lit(many)), times).otherwise(best)

    return let(let(_read(text), read), lambda found: F.when(found > 0, found))


def parse_mass_kg(text: Column, volume: bool = True) -> Column:
    """Kilograms of parse_mass, or of parse_amount without volume."""
    return parse_mass(text)["kg"] if volume else parse_amount(text)


def parse_volume_ml(text: Column) -> Column:
    return parse_amount(text, "volume")


def embedded_rates(text: Column) -> Column:
    """struct<per_kg, per_lb> of prices such as $7.69/1kg, the last of each unit; null where absent."""
    return let(_read(text), _rates)


def _rates(t: Column) -> Column:
    def last(unit: str) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(rf"\$?\s*{_NUMBER}\s*/\s*(?:1\s*)?({unit})\b"), F.lit(1)), lambda x: x.cast("double"))
        return F.try_element_at(F.filter(found, lambda x: x > 0), F.lit(-1))

    return F.struct(last("kg").alias("per_kg"), last("lbs?").alias("per_lb"))


def count_pack(text: Column) -> Column:
    """struct<inner, outer, total> of pieces, null if none is named.

    In this order: N x M dozen (1 to 60 dozen), N x M ea (N from 2, M 6 to 360, 720 in all), the
    largest N ea of 6 to 360, a dozen, N pack of 6 to 36, a bare 6, 12, 18, 24, 30, 36 or 60.
    """
    return let(_read(text), _counted)


def _counted(t: Column) -> Column:
    n = lambda p, i=1: F.regexp_extract(t, p, i).try_cast("long")
    pack = lambda inner, outer: F.struct(inner.cast("long").alias("inner"), outer.cast("long").alias("outer"), (inner * outer).cast("long").alias("total"))
    dozens, eaches, packs, bare = r"(\d+)\s*[x×]\s*(\d+)\s*doz(?:en)?\b", r"(\d+)\s*[x×]\s*(\d+)\s*(?:ea|count|ct|eggs?)\b", r"\b(\d+)\s*pack\b", r"\b(6|12|18|24|30|36|60)\b"
    singles = F.filter(
        F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)\s*(?:ea|count|ct|eggs?)\b"), F.lit(1)), lambda x: x.try_cast("long")), lambda x: x.between(6, 360)
    )
    d, outer, inner = n(dozens) * n(dozens, 2), n(eaches), n(eaches, 2)
    return (
        F.when(d.between(1, 60), pack(F.lit(12), d))
        .when((outer >= 2) & inner.between(6, 360) & (outer * inner <= 720), pack(inner, outer))
        .when(F.size(singles) > 0, pack(F.array_max(singles), F.lit(1)))
        .when(t.rlike(r"\bdozen\b|\d\s*doz(?:en)?\b|\bdoz\b"), pack(F.lit(12), F.lit(1)))
        .when(n(packs).between(6, 36), pack(n(packs), F.lit(1)))
        .when(n(bare).isNotNull(), pack(n(bare), F.lit(1)))
    )


def parse_count_pack(text: Column) -> Column:
    """Pieces in all of count_pack."""
    return count_pack(text)["total"]


def has_weight_rate(text: Column) -> Column:
    return let(embedded_rates(text), lambda r: r["per_kg"].isNotNull() | r["per_lb"].isNotNull()) | F.lower(text).rlike(LOOSE)


def content_kg(text: Column, parsed_kg: Column | None = None) -> Column:
    """Kilograms of content that a title prints, never a volume; else what was parsed before, unless the title names a rate."""
    printed = let(parse_mass(text), lambda m: F.when((m["kg"] > 0) & ~m["unit"].isin("ml", "l", "lt"), m["kg"]))
    before = [] if parsed_kg is None else [F.when((parsed_kg > 0) & ~has_weight_rate(text), parsed_kg)]
    return F.coalesce(printed, parse_amount(text), *before)


def describe_sale(text: Column, sold_by_weight: Column, parsed_kg: Column | None = None) -> Column:
    """struct<sale_mode, purchase_unit, content_kg, content_ml>: case, fixed_pack or loose_weight, by what the title says."""
    t = F.lower(text)
    facts = F.struct(
        content_kg(text, parsed_kg).alias("kg"), t.rlike(EACH).alias("each"), has_weight_rate(text).alias("rate"), t.rlike(CONTAINER).alias("container"),
        (t.rlike(CASE) | t.rlike(MULTI_PACK)).alias("case"), F.coalesce(sold_by_weight, F.lit(False)).alias("weighed"), parse_volume_ml(text).alias("ml"),
    )

    def made(x: Column) -> Column:
        discrete = x["container"] | x["each"] | (F.coalesce(x["kg"] > 0, F.lit(False)) & ~x["rate"])
        mode = (
            F.when(x["case"], "case").when(discrete, "fixed_pack").when(x["rate"], "loose_weight")
            .when(x["weighed"] & x["kg"].isNull(), "loose_weight").otherwise("fixed_pack")
        )
        unit = F.when(x["case"], "case").when(discrete & x["each"], "ea").otherwise("pack")
        return F.struct(mode.alias("sale_mode"), unit.alias("purchase_unit"), x["kg"].alias("content_kg"), x["ml"].alias("content_ml"))

    return let(facts, made)


def sale_mode(text: Column, sold_by_weight: Column, parsed_kg: Column | None = None) -> Column:
    return describe_sale(text, sold_by_weight, parsed_kg)["sale_mode"]


def size_agreement(kg_a: Column, kg_b: Column, count_a: Column, count_b: Column) -> Column:
    """same, close, different or unknown; counts decide where both sides have one."""
    ratio = F.greatest(count_a, count_b) / F.least(count_a, count_b)
    apart = F.abs(kg_a - kg_b) / F.least(kg_a, kg_b)
    by_count = F.when(count_a == count_b, "same").when(ratio <= 1.12, "close").otherwise("different")
    by_mass = F.when(apart <= 0.12, "same").when(apart <= 0.2, "close").otherwise("different")
    return F.when(count_a.isNotNull() & count_b.isNotNull(), by_count).when((kg_a > 0) & (kg_b > 0), by_mass).otherwise("unknown")


def dimension_of(unit: Column) -> Column:
    """mass, volume or count, as everything else counts."""
    return F.when(unit.isin("g", "kg"), "mass").when(unit.isin("ml", "l"), "volume").otherwise("count")


def to_base(value: Column, unit: Column) -> Column:
    """struct<amount, unit> in grams, millilitres or pieces."""
    amount = F.when(unit.isin("kg", "l"), value * 1000).otherwise(value)
    return F.struct(amount.alias("amount"), F.when(unit.isin("kg", "g"), "g").when(unit.isin("l", "ml"), "ml").otherwise("ea").alias("unit"))


def from_base(value: Column, unit: Column) -> Column:
    return F.when(unit.isin("kg", "l"), value / 1000).otherwise(value)


def convert(value: Column, unit: Column, to: Column) -> Column:
    """Between units of one dimension (g kg lb oz, ml l, ea dozen); null across dimensions."""
    mass, volume, count = {u: KG[u] for u in ("kg", "g", "lb", "lbs", "oz")}, {"ml": 0.001, "l": 1.0}, {"ea": 1.0, "dozen": 12.0}
    return F.coalesce(*[value * _of(unit, t) / _of(to, t) for t in (mass, volume, count)])


def kg_to_lb(kg: Column) -> Column:
    return kg / KG_PER_LB


def lb_to_kg(lb: Column) -> Column:
    return lb * KG_PER_LB


def default_weight_unit(retailer: Column) -> Column:
    """The unit of a retailer's shelf labels: pounds at two of them."""
    return F.when(retailer.isin("no_frills", "wholesale_club"), "lb").otherwise("kg")


def weight_price_unit(product_id: Column, text: Column, default: Column) -> Column:
    """Unit of a price by weight: the id's ending, else what only the text names, else the default."""
    i, t = F.upper(product_id), F.lower(text)
    lb, kg = t.rlike(r"(?:^|[\s/])(?:lb|lbs)\b|/\s*lb|per\s*lb"), t.rlike(r"(?:^|[\s/])kg\b|/\s*kg|per\s*kg")
    return (
        F.when(i.endswith("_LB") | i.contains("_LB_"), "lb").when(i.endswith("_KG") | i.contains("_KG_"), "kg")
        .when(lb & ~kg, "lb").when(kg & ~lb, "kg").otherwise(default)
    )


def _number_text(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def unit_prices(product_id: Column, name: Column, size: Column, retailer: Column, price: Column, unit_price: Column, by_weight: bool = False) -> Column:
    """struct<per_kg, per_lb, unit, price, basis> of an offer, null where none can be told.

    The first that applies: a rate in the text; a price by weight (by_weight, the id's ending, or wording);
    the given unit price, unless it is over 20 times price / mass or over the larger of 50 times the price and 80;
    price / mass of the pack.
    """
    size_, text = F.coalesce(size, F.lit("")), F.concat(name, F.lit(" "), F.coalesce(size, F.lit("")))
    i, shown = F.upper(product_id), default_weight_unit(retailer)
    facts = F.struct(
        let(embedded_rates(F.concat(size_, F.lit(" "), name)), lambda r: F.coalesce(r["per_kg"], r["per_lb"] / KG_PER_LB)).alias("rate"),
        F.coalesce(parse_mass(size), parse_mass(name)).alias("mass"), shown.alias("shown"), weight_price_unit(product_id, text, shown).alias("of"),
        (F.lit(by_weight) | i.endswith("_KG") | i.endswith("_LB") | F.lower(text).rlike(r"\b(?:per|\/)\s*(?:kg|lb)\b")).alias("weighed"),
        price.cast("double").alias("price"), unit_price.cast("double").alias("given"),
    )

    def chosen(x: Column) -> Column:
        kg, p, given = x["mass"]["kg"], x["price"], x["given"]
        usable = (given > 0) & ~F.coalesce((kg > 0) & (p > 0) & (given > p / kg * 20), F.lit(False)) & ~((p > 0) & (given > F.greatest(p * 50, F.lit(80.0))))
        per = lambda v: F.when(x["of"] == "lb", v / KG_PER_LB).otherwise(v)
        name_ = x["mass"]["unit"]
        unit = F.when(name_ == "gr", "g").when(name_ == "lbs", "lb").when(name_ == "lt", "l").when(name_.startswith("ounce"), "oz").otherwise(name_)
        pack = F.concat(F.lit("pack_"), _number_text(x["mass"]["value"]), unit)
        return F.struct(
            F.when(x["rate"] > 0, x["rate"]).when(x["weighed"], per(p)).when(usable, per(given)).when(kg > 0, p / kg).alias("per_kg"), x["shown"].alias("shown"),
            F.when(x["rate"] > 0, "embedded_rate").when(x["weighed"], F.concat(F.lit("sold_by_"), x["of"])).when(usable, "unitPrice").otherwise(pack).alias("basis"),
        )

    def told(y: Column) -> Column:
        lb = r2(y["per_kg"] * KG_PER_LB)
        return F.when(
            y["per_kg"] > 0,
            F.struct(
                r2(y["per_kg"]).alias("per_kg"), lb.alias("per_lb"), y["shown"].alias("unit"), F.when(y["shown"] == "lb", lb).otherwise(r2(y["per_kg"])).alias("price"), y["basis"].alias("basis"),
            ),
        )

    return let(let(facts, chosen), told)


def price_for_mass(kg: Column, *offer: Column) -> Column:
    """struct<total, per_kg, basis> of a mass of an offer (the columns of unit_prices); sold by weight where nothing else tells."""
    found = F.coalesce(unit_prices(*offer), unit_prices(*offer, by_weight=True))
    priced = lambda u: F.when((kg > 0) & u.isNotNull(), F.struct(r2(u["per_kg"] * kg).alias("total"), u["per_kg"].alias("per_kg"), u["basis"].alias("basis")))
    return let(found, priced)


def mass_match_score(kg: Column, target: Column, tolerance: float = 0.12) -> Column:
    """How well a pack fits a wanted mass: 3 within the tolerance, 1 within 25 %, -4 below 0.6, -2 above 1.6 times, else -1; 0 if unknown."""
    off = F.abs(kg - target) / target
    return F.when(kg.isNull() | target.isNull(), 0).when(off <= tolerance, 3).when(off <= 0.25, 1).when(kg / target < 0.6, -4).when(kg / target > 1.6, -2).otherwise(-1)


def format_mass(kg: Column) -> Column:
    return F.when(kg >= 1, F.concat(_number_text(r2(kg)), F.lit(" kg"))).otherwise(F.concat(F.floor(kg * 1000 + 0.5).cast("string"), F.lit(" g")))


def format_money(price: Column, unit: Column) -> Column:
    """A price of a unit of weight or of a piece, such as $1.50 / kg."""
    return F.format_string("$%.2f / %s", r2(price), unit)


def pack_mass_kg(text: Column, parsed_kg: Column) -> Column:
    """The mass parsed before wins even at 0, which is null; else that of the text."""
    own = let(parse_mass(text)["kg"], lambda kg: F.when(kg > 0, kg))
    return F.when(parsed_kg.isNotNull(), F.when(parsed_kg > 0, parsed_kg)).otherwise(own)


def infer_pack_kg(price: Column, per_100: Column, hint: Column) -> Column:
    """Kilograms of a pack from its price and the price of 100 ml or 100 g."""
    known = F.lower(F.coalesce(hint, F.lit(""))).rlike("ml|g|^$")
    return F.when((price > 0) & (per_100 > 0) & known, price / per_100 * 100 / 1000)


def numeric_alias_ids(sku: Column) -> Column:
    """A numeric id and those one below and above, as text; any other id alone."""
    n = sku.try_cast("decimal(38,0)")
    near = F.array(sku, (n - 1).cast("decimal(38,0)").cast("string"), (n + 1).cast("decimal(38,0)").cast("string"))
    return F.when(sku.rlike(r"^\d+$") & n.isNotNull(), near).otherwise(F.array(sku))


def price_jump_too_big(before: Column, now: Column) -> Column:
    """Four times as much or a quarter."""
    return F.coalesce((before > 0) & (now > 0) & (F.greatest(before, now) / F.least(before, now) >= 4), F.lit(False))
