"""The identity decision as a query: parts stand for offers, the second word of a name with one of four settings for the product."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import decision
from larder.plans.catalogue import query

SUFFIX = ["", " canned", " frozen", " fresh", " acme", " free run", " round", " extra large", " 500 ml", " 300 ml", " paste", " fresh frozen", " red"]
#: Settings of a product by its noun and number, and an offer's columns, as SQL that both engines read.
ITEM = {
    "label": "CASE k WHEN 1 THEN concat('Acme ', noun, ' large 2 l') WHEN 3 THEN concat('White quinoa ', noun) ELSE noun END", "exact": "k < 2", "category": "CASE WHEN k = 2 THEN 'produce' WHEN k = 3 AND noun = 'gear' THEN 'frozen' END",
    "form": "CASE WHEN k = 3 AND noun = 'bolt' THEN 'fresh' END", "type": "CASE WHEN k = 0 AND noun <> 'nut' THEN noun END", "variant": "CASE WHEN noun = 'widget' THEN 'rectangular' END",
    "preferred_id": "CASE WHEN k = 1 THEN 'p-100' END", "confirmed_id": "CASE WHEN noun = 'ring' THEN 'sku-7' END", "barcode": "CASE WHEN noun = 'bolt' THEN '0062715000013' END",
}
OFFER = {
    "product_id": "CASE WHEN p_partkey % 17 = 0 THEN 'p-100' WHEN p_partkey % 6 = 0 THEN 'sku-7-ea' ELSE concat('id-', p_partkey) END",
    "name": f"CASE p_partkey % 13 {' '.join(f'''WHEN {i} THEN concat(p_name, '{s}')''' for i, s in enumerate(SUFFIX))} END", "brand": "CASE p_partkey % 5 WHEN 1 THEN 'Acme' WHEN 2 THEN 'Vegetables' END",
    "upc": "CASE WHEN p_partkey % 7 = 0 THEN '062715000013' END", "produce_reason": "CASE WHEN p_size % 9 = 0 THEN 'title' END",
}
WORDS = {"must_not": "CASE WHEN k = 0 THEN 'acme' WHEN k = 1 THEN 'Free Run eggs' END", "must_all": "CASE WHEN k = 1 THEN noun WHEN k = 3 THEN '2 l' END", "must_any": "CASE WHEN k = 2 THEN 'red' WHEN noun = 'nut' THEN 'nut' END"}


def _sql() -> str:
    has = lambda hay, w: f"CASE WHEN contains({w}, ' ') THEN contains(lower({hay}), lower({w})) ELSE regexp_matches(lower({hay}), '(^|[^a-z0-9])' || lower({w}) || '(es|s)?([^a-z0-9]|$)') END"
    listed = lambda cols: ", ".join(f"{e} AS {c}" for c, e in cols.items())
    scope = {
        "fresh": "fresh", "fresh_tomato": "fresh AND item = 'tomato'", "fresh_item": "fresh AND item = 'tomato'", "frozen": "frozen", "white_quinoa": "contains(lower(label), 'quinoa')",
        "rectangular": "variant = 'rectangular'", "variant": "variant = 'round'",
    }
    plain = lambda p: p.removeprefix("(?i)")
    forms = " ".join(
        f"WHEN coalesce({scope[r.field]}, false) AND regexp_matches(whole, '{plain(r.pattern)}')" + (f" AND NOT regexp_matches(whole, '{r.unless}')" if r.unless else "") + f" THEN '{r.reason}'" for r in decision.FORMS
    )
    return f"""WITH n AS (SELECT *, p_partkey % 4 AS k, substr(p_name, strpos(p_name, ' ') + 1) AS noun FROM part),
o AS (SELECT noun || '-' || k AS item, p_partkey AS offer_id, noun, k, {listed(ITEM)}, {listed(WORDS)}, {listed(OFFER)} FROM n),
t AS (SELECT *, lower(concat_ws(' ', coalesce(brand, ''), name, '')) AS text, replace(product_id, '-', ' ') AS handle, k > 1 AS split, coalesce(form = 'fresh' OR category = 'produce', false) AS fresh, coalesce(category = 'frozen', false) AS frozen FROM o),
s AS (SELECT *, text || ' ' || handle AS whole, CASE WHEN split THEN concat_ws(' ', CASE WHEN brand = 'Vegetables' THEN '' ELSE coalesce(brand, '') END, name, '', handle) ELSE text END AS sought FROM t),
w AS (SELECT *, CASE WHEN confirmed_id IS NOT NULL AND (contains(product_id, confirmed_id) OR contains(confirmed_id, product_id)) THEN 'confirmed' WHEN "exact" AND barcode IS NOT NULL AND upc IS NOT NULL AND ends_with(upc, right(barcode, 12)) THEN 'barcode'
    WHEN "exact" AND product_id = preferred_id THEN 'preferred' ELSE 'rules' END AS way,
  CASE WHEN must_not IS NOT NULL AND {has('sought', 'must_not')} THEN 'must_not:' || must_not WHEN must_all IS NOT NULL AND must_all <> '2 l' AND NOT {has('sought', 'must_all')} THEN 'must_all:' || must_all
    WHEN must_any IS NOT NULL AND NOT {has('sought', 'must_any')} THEN 'must_any' WHEN type IS NOT NULL AND NOT {has('sought', 'type')} THEN 'type:' || type END AS words,
  CASE {forms} END AS forms,
  CASE WHEN k = 1 AND contains(name, '300 ml') THEN 'size_ml' WHEN k = 1 AND contains(name, 'extra large') THEN 'large_not_extra_large' WHEN k = 1 AND contains(text, 'free run') THEN 'free_run'
    WHEN k = 1 AND NOT {has('text', "'acme'")} THEN 'other_brand' WHEN k = 0 AND preferred_id IS NULL AND barcode IS NULL AND confirmed_id IS NULL AND NOT {has('text', "coalesce(type, must_any, lower(noun))")} THEN 'other_type' END AS strict
  FROM s)
SELECT item, offer_id, CASE WHEN way <> 'rules' THEN true ELSE coalesce(words, forms, CASE WHEN "exact" THEN strict WHEN fresh AND category = 'produce' OR frozen THEN produce_reason END) IS NULL END AS ok, way,
  CASE WHEN way = 'rules' THEN coalesce(words, forms, CASE WHEN "exact" THEN strict WHEN (fresh AND category = 'produce' OR frozen) AND produce_reason IS NOT NULL THEN 'produce' END) END AS reason FROM w"""


@query(_sql())
def identity_decision(t):
    named = t("part").select("*", (F.col("p_partkey") % 4).alias("k"), F.element_at(F.split("p_name", " ", 2), -1).alias("noun")).withColumn("item", F.concat_ws("-", "noun", F.col("k").cast("string")))
    items = named.select("item", "noun", "k").distinct().select("item", *[F.expr(e).alias(c) for c, e in ITEM.items()], *[F.when(F.expr(e).isNotNull(), F.array(F.expr(e))).alias(c) for c, e in WORDS.items()])
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    offers = named.select("item", F.col("p_partkey").alias("offer_id"), *[F.expr(e).alias(c) for c, e in OFFER.items()], *none("string", "size", "url"), *none("double", "parsed_kg"))
    return decision.decide(offers, items)
