"""JSON of unknown depth: every object of a document, found level by level, and the product tiles among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.offers import parse_money
from larder.sources.shared import cut

DEEPEST = 10_000  # a payload that claims to be deeper is taken for broken


def objects(documents: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """(key..., path array<struct<pos, key>>, v) of every object at any depth of the JSON texts, the outermost too.

    The frontier of one level, all objects and arrays, is exploded into the next until it is empty; each level is one pass over what the
    level before holds, without a shuffle, and is checkpointed, so the work is in proportion to the values of the documents. Fields of
    an object come in the order of their names. Null and invalid texts have no objects.
    """
    document = F.try_parse_json(F.col(payload))
    empty = F.expr("cast(array() as array<struct<pos:int,key:string>>)")
    frontier = documents.select(*key, empty.alias("path"), document.alias("v")).where("v is not null")
    found = None
    for _ in range(DEEPEST):
        frontier = cut(frontier.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
        if frontier.isEmpty():
            break
        level = frontier.where(F.schema_of_variant("v").startswith("OBJECT"))
        found = level if found is None else found.unionByName(level)
        inside = frontier.sparkSession.tvf.variant_explode(F.col("v").outer())
        step = F.struct(F.col("pos").cast("int").alias("pos"), F.col("key").alias("key"))
        names = [F.col(f"a.{c}") for c in key]
        frontier = frontier.alias("a").lateralJoin(inside.alias("b")).select(*names, F.concat(F.col("a.path"), F.array(step)).alias("path"), F.col("b.value").alias("v"))
    else:
        raise ValueError(f"a payload is more than {DEEPEST} levels deep")
    return found if found is not None else frontier.limit(0)


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def tiles(documents: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """(key..., product_id, name, brand, package_size, price) of the products in the JSON texts of each key, at whatever depth.

    A product is an object in an array productTiles, or one with a price, an id and a name. Those without an id or a price are left out; of several
    with one id the first counts, by the place in its document and then by the text of its values. Extra columns of the documents are ignored.
    """
    found = objects(documents, key, payload)
    steps = F.col("path")
    tile = (F.size(steps) >= 2) & (F.get(steps, F.size(steps) - 2)["key"] == "productTiles") & F.get(steps, F.size(steps) - 1)["key"].isNull()
    has = lambda *names: F.coalesce(*[F.when(F.coalesce(_text(f"$.{n}"), F.lit("")) != "", True) for n in names], F.lit(False))
    priced = F.coalesce(*[F.when(~F.is_variant_null(F.try_variant_get("v", f"$.{n}", "variant")), True) for n in ("pricing", "prices", "price")], F.lit(False))
    own = priced & has("productId", "offerId", "articleNumber") & has("title", "name")
    amount = F.coalesce(*[parse_money(_text(p)) for p in ("$.pricing.price", "$.pricing.displayPrice", "$.pricing.regularPrice", "$.prices.price", "$.price.price", "$.price")])
    rows = found.where(tile | own).select(
        *key, "path", F.coalesce(*[_text(f"$.{n}") for n in ("productId", "articleNumber", "code", "productCode")]).alias("product_id"),
        F.coalesce(_text("$.title"), _text("$.name"), F.lit("Unknown product")).alias("name"), F.coalesce(_text("$.brand.name"), _text("$.brand")).alias("brand"),
        F.coalesce(_text("$.packageSizing"), _text("$.packageSize"), _text("$.size")).alias("package_size"), amount.alias("price"),
    ).where("product_id <> '' and price is not null")
    values = ("name", "brand", "package_size", "price")
    first = rows.groupBy(*key, "product_id").agg(F.min(F.struct(F.transform("path", lambda s: s["pos"]).alias("at"), *values)).alias("m"))
    return first.select(*key, "product_id", *[F.col(f"m.{c}").alias(c) for c in values])
