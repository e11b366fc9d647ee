"""Products in nested payloads as a query: the parts of a brand and type land as one JSON text, each at another depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans.catalogue import query
from larder.sources import walk

#: One part as JSON, as SQL that both engines read: bare, in objects, in product tiles, in lists; every eleventh has no price.
_TILE = """concat('{"productId":"', p_partkey % 50, '","title":"', p_name, '","packageSizing":"', p_size, ' g",', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('"pricing":{"price":"$', p_size, '.25"},') END, '"brand":{"name":"', p_brand, '"}}')"""
PIECE = f"""CASE p_size % 5 WHEN 0 THEN {_TILE} WHEN 1 THEN concat('{{"layout":{{"zone":', {_TILE}, '}}}}') WHEN 2 THEN concat('{{"rows":[[{{"productTiles":[', {_TILE}, ',null]}}],3]}}')
  WHEN 3 THEN concat('[[[[{{"b":{{"c":[', {_TILE}, ',{{"name":"x"}}]}}}}]]]]') ELSE concat('{{"productTiles":[', replace({_TILE}, 'title', 'name'), ']}}') END"""

_SQL = f"""WITH p AS (SELECT p_brand, p_type, '[' || string_agg({PIECE}, ',' ORDER BY p_partkey) || ']' AS payload FROM part GROUP BY p_brand, p_type),
t AS (SELECT p_brand, p_type, j.id, j.fullkey, j.value AS v FROM p, json_tree(payload) j WHERE j.type = 'OBJECT'),
f AS (SELECT *, coalesce(json_extract_string(v, '$.title'), json_extract_string(v, '$.name'), 'Unknown product') AS name, json_extract_string(v, '$.productId') AS product_id, TRY_CAST(regexp_replace(json_extract_string(v, '$.pricing.price'), '[^0-9.]', '', 'g') AS DOUBLE) AS price FROM t
  WHERE regexp_matches(fullkey, 'productTiles\\[[0-9]+\\]$') OR (json_extract(v, '$.pricing') IS NOT NULL AND json_extract_string(v, '$.productId') IS NOT NULL AND (json_extract_string(v, '$.title') IS NOT NULL OR json_extract_string(v, '$.name') IS NOT NULL)))
SELECT p_brand, p_type, product_id, name, json_extract_string(v, '$.brand.name') AS brand, json_extract_string(v, '$.packageSizing') AS package_size, price FROM f
WHERE product_id IS NOT NULL AND price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, product_id ORDER BY id) = 1"""


@query(_SQL)
def payload_tiles(t):
    pieces = t("part").select("p_brand", "p_type", F.struct("p_partkey", F.expr(PIECE).alias("piece")).alias("p"))
    texts = pieces.groupBy("p_brand", "p_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), ",").alias("inner"))
    return walk.tiles(texts.select("p_brand", "p_type", F.concat(F.lit("["), "inner", F.lit("]")).alias("payload")), ["p_brand", "p_type"])
