"""Landed payloads: JSON documents, receipt files, product pages, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.expr import fresh
from larder.functions.money import r2
from larder.functions.units import parse_mass_kg

RECEIPT_SCHEMA = (
    "date date, store string, upc string, name string, qty double, unit_price double, line_total double, product_id string, retailer string, source_image string"
)
TILE_SCHEMA = (
    "productId string, title string, brand string, packageSizing string, pricing struct<price:string,wasPrice:string>,"
    " pricingUnits struct<type:string,unit:string,weighted:boolean>, link string, textBadge string"
)
SHOP_SCHEMA = "checkedAt string, products array<struct<id:string,title:string,handle:string,vendor:string,variants:array<struct<sku:string,available:boolean,price:string>>>>"


def json_field(document: Column, path: str, kind: str) -> Column:
    """A scalar of a JSON text by path; null for invalid JSON or an absent path."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def receipts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Receipt lines; barcodes stay text for their leading zeros, absent columns are null."""
    names = {c.split()[0]: c.split()[1] for c in RECEIPT_SCHEMA.split(", ")}
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[(F.col(n).try_cast(k) if n in raw.columns else F.lit(None).cast(k)).alias(n) for n, k in names.items()])


def tile_offers(documents: DataFrame) -> DataFrame:
    """Offers of product tiles: rows (payload), each a JSON array. A weighted tile carries the price of its unit."""
    tiles = documents.select(F.inline(F.from_json("payload", _array_of(TILE_SCHEMA))))
    return tiles.select(
        F.col("productId").alias("product_id"), F.col("title").alias("name"), "brand", F.col("packageSizing").alias("package_size"),
        F.col("pricing.price").try_cast("double").alias("price"), F.col("pricing.wasPrice").try_cast("double").alias("was_price"),
        F.coalesce("pricingUnits.weighted", F.lit(False)).alias("by_weight"),
    )


def _array_of(schema: str) -> str:
    fields = ",".join(f"{part.strip().split(' ', 1)[0]}:{part.strip().split(' ', 1)[1]}" for part in _top_level(schema))
    return f"array<struct<{fields}>>"


def _top_level(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def shop_offers(documents: DataFrame) -> DataFrame:
    """Offers of a shop export: rows (payload), one per product variant in stock."""
    products = documents.select(F.from_json("payload", SHOP_SCHEMA).alias("d")).select("d.checkedAt", F.explode("d.products").alias("p"))
    variants = products.select("checkedAt", "p", F.explode("p.variants").alias("v")).where("v.available")
    return variants.select(
        F.coalesce("v.sku", "p.id").alias("product_id"), F.col("p.title").alias("name"), F.col("p.vendor").alias("brand"),
        F.col("v.price").try_cast("double").alias("price"), F.col("checkedAt").try_cast("timestamp").alias("checked_at"),
    )


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both by key, the newest by `order`, a change before an equally new base row; one aggregation, no join."""
    columns = [c for c in base.columns if c not in key]
    side = fresh("side", base.columns)
    both = base.withColumn(side, F.lit(0)).unionByName(changes.select(base.columns).withColumn(side, F.lit(1)))
    best = both.groupBy(*key).agg(F.max(F.struct(order, side, *[c for c in columns if c != order])).alias("m"))
    return best.select(*[F.col(c) if c in key else F.col(f"m.{c}").alias(c) for c in base.columns])


def tag_value(tags: Column, key: str) -> Column:
    """The text after KEY: of the last tag that begins so, in tags such as INSTOREPRICE:16.59; null without one."""
    found = F.filter(tags, lambda t: F.substring_index(t, ":", 1) == key)
    return F.nullif(F.substring(F.try_element_at(found, F.lit(-1)), len(key) + 2, 1 << 20), F.lit(""))


def tagged_offers(documents: DataFrame) -> DataFrame:
    """Offers of a shop export whose shelf price is a tag: rows (payload), one per product with the tag INSTOREPRICE.

    A variant's own price is the online one and never stands for the shelf; without a positive tag there is no offer.
    Of several variants the first gives barcode and availability. A title by the kilogram has a mass of 1.
    """
    fields = "id:string,title:string,handle:string,vendor:string,tags:array<string>,variants:array<struct<sku:string,available:boolean,price:string,grams:string>>"
    products = documents.select(F.from_json("payload", f"products array<struct<{fields}>>").alias("d")).select(F.explode("d.products").alias("p"))
    number = lambda t: F.regexp_extract(t, r"^\s*(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    price, first = number(tag_value(F.col("p.tags"), "INSTOREPRICE")), F.get("p.variants", F.lit(0))
    code = F.regexp_replace(F.coalesce(first["sku"], F.lit("")), r"\D", "")
    by_kg = F.lower("p.title").rlike(r"per\s*kg")
    rows = products.select(
        F.col("p.id").alias("product_id"), F.col("p.title").alias("name"), F.nullif(F.trim("p.vendor"), F.lit("")).alias("brand"), price.alias("price"),
        number(tag_value(F.col("p.tags"), "MARKUP")).alias("markup"), F.when(F.length(code) >= 8, code).alias("upc"),
        F.when(first["available"], "in_stock").when(~first["available"], "out_of_stock").otherwise("unknown").alias("availability"),
        F.when(by_kg, 1.0).otherwise(F.coalesce(parse_mass_kg(F.col("p.title")), F.when(first["grams"].try_cast("double") > 0, first["grams"].try_cast("double") / 1000))).alias("kg"),
    )
    return rows.where("price > 0").withColumn("unit_price", F.when(F.col("kg") > 0, r2(F.col("price") / F.col("kg"))))


def merge_upsert(base: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both by key, each field the newest that is not null by `order`, a change before an equally new base row.

    Fields that a change lacks keep what was known; one aggregation, no join. Rows with a null order are the oldest.
    """
    columns = [c for c in base.columns if c not in key]
    both = base.select("*", F.lit(0).alias("src__")).unionByName(changes.select("*", F.lit(1).alias("src__")), allowMissingColumns=True)
    rank = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.col("src__").alias("src"))
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    return both.groupBy(*key).agg(*newest).select(*base.columns)
