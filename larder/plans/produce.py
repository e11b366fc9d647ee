"""Decisions on produce as a query: parts stand for offers, the second word of a name for the product; its SQL tries every word in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import produce
from larder.plans.catalogue import query

SUFFIX = ["", " juice", " ice cream", " pints", " sunny valley gold", " 500 g", " 1 ea", " case 2 x 3", " fresh farmers", " pies", " acme premium"]
#: The columns of an offer by its number, as SQL that both engines read; {noun} is the second word of its name.
OFFER = {
    "name": f"CASE p_partkey % 11 {' '.join(f'''WHEN {i} THEN concat(CASE WHEN p_partkey % 6 = 5 THEN 'VEGETABLES - ' ELSE '' END, p_name, '{s}')''' for i, s in enumerate(SUFFIX))} END",
    "brand": "CASE p_partkey % 4 WHEN 1 THEN 'Vegetables' WHEN 2 THEN 'Great Value' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'Odd Imports Ltd' END END",
    "url": "CASE p_partkey % 7 WHEN 1 THEN concat('https://shop.example/en/', {noun}, '-candle/1') WHEN 2 THEN concat('https://shop.example/en/p/', {noun}, '-kitchen-towel/1') WHEN 3 THEN concat('/', {noun}) WHEN 4 THEN concat('https://shop.example/ip/', {noun}, 's/2') END",
    "filter_reason": "CASE WHEN p_size % 10 = 0 THEN 'mustIncludeAny' END",
}
ITEM = {"category": "CASE WHEN item IN ('gear', 'bolt') THEN 'frozen' ELSE 'produce' END", "max_kg": "CASE WHEN item IN ('ring', 'gear') THEN 0.4 END", "reject": "CASE WHEN item = 'widget' THEN 'acme' END"}


def _sql() -> str:
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    toks = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+'))"
    stem = lambda t: f"CASE WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, -3) || 'y' WHEN ends_with({t}, 'oes') AND length({t}) > 4 THEN left({t}, -2) WHEN ends_with({t}, 's') AND NOT ends_with({t}, 'ss') AND length({t}) > 3 THEN left({t}, -1) ELSE {t} END"
    has = lambda hay, w: f"CASE WHEN contains({w}, ' ') THEN contains(lower({hay}), {w}) ELSE regexp_matches(lower({hay}), '(^|[^a-z0-9])' || {w} || '(es|s)?([^a-z0-9]|$)') END"
    ok = lambda w: f"({has('blob', w)} OR ({w} = 'frozen' AND frozen))"

    def impostor(hay: str, shapes: bool = True) -> str:
        junk = f"list_filter({listed(produce.JUNK)}, lambda j: {has(hay, 'j')} AND NOT {ok('j')})[1]"
        shape = f"CASE WHEN frozen THEN list_filter({listed(produce.FRESH_SHAPES)}, lambda j: {has(hay, 'j')})[1] END"
        return f"coalesce({junk}, CASE WHEN reject IS NOT NULL AND NOT {has('blob', 'reject')} AND {has(hay, 'reject')} THEN reject END, {shape})"

    left = lambda ws: f"list_filter({ws}, lambda t: NOT ({stem('t')} = {stem('item')} OR list_contains(known, {stem('t')}) OR regexp_matches(t, '{produce.SIZE_WORD}')))"
    junked = lambda ws: f"len(list_filter({ws}, lambda t: NOT {ok('t')} AND len(list_filter({listed(produce.JUNK)}, lambda j: NOT {ok('j')} AND {has('t', 'j')})) > 0)) > 0"
    view = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^(fruits|vegetables)\s*[-–]\s*', '', 'i'), '\bcase\b', ' ', 'gi'), '\bpints?\b', 'pack', 'gi'), '\b\d+\s*x\s*\d+\b', ' ', 'gi')"
    offer = ", ".join(f"{e.replace('{noun}', 'item')} AS {c}" for c, e in OFFER.items())
    return f"""WITH n AS (SELECT *, CASE WHEN p_partkey % 5 = 4 THEN 'gear' ELSE substr(p_name, strpos(p_name, ' ') + 1) END AS item FROM part),
i AS (SELECT DISTINCT item, {', '.join(f'{e} AS {c}' for c, e in ITEM.items())} FROM n),
o AS (SELECT n.item, p_partkey AS offer_id, category = 'frozen' AS frozen, CAST(max_kg AS DOUBLE) AS max_kg, reject, lower(item || ' ' || category || ' ' || item) AS blob, {offer} FROM n JOIN i USING (item)),
v AS (SELECT *, {view} AS view, CASE WHEN regexp_full_match(lower(coalesce(brand, '')), 'fruits|vegetables') THEN '' ELSE coalesce(brand, '') END AS view_brand,
  CASE WHEN regexp_full_match(lower(coalesce(brand, '')), 'fruits|vegetables') OR regexp_matches(lower(name), '^(fruits|vegetables)\\s*[-–]') THEN '' ELSE coalesce(url, '') END AS view_url,
  CASE WHEN contains(name, '500 g') THEN 0.5 END AS kg, contains(name, '1 ea') AS piece, list_distinct(list_transform({listed(produce.SIZES + produce.HOUSE)}, lambda t: {stem('t')})) AS known FROM o),
s AS (SELECT *, {toks('view')} AS w, {toks("view_brand || ' ' || view")} AS tw, {toks("CASE WHEN contains(view_url, '://') THEN list_filter(string_split(regexp_replace(view_url, '^https://[^/]*', ''), '/'), lambda p: p NOT IN ('', 'en', 'p', 'ip') AND NOT regexp_matches(p, '^[0-9]') AND length(p) > 2)[1] ELSE view_url END")} AS sw FROM v),
f AS (SELECT *, {impostor("concat_ws(' ', brand, name, url)")} AS raw_word, {impostor("concat_ws(' ', view_brand, view, view_url)")} AS view_word,
  {impostor("array_to_string(sw, ' ')")} AS slug_word, {left('w')} AS wl, {left('tw')} AS tl, {left('sw')} AS sl,
  len(list_filter(w, lambda t: {stem('t')} = {stem('item')})) > 0 AS core, kg > max_kg AS large FROM s),
r AS (SELECT *, CASE WHEN raw_word IS NOT NULL THEN 'impostor' WHEN large THEN 'too_large' WHEN filter_reason IS NOT NULL THEN 'filter' WHEN view_word IS NOT NULL THEN 'warehouse_impostor' WHEN frozen THEN NULL
  WHEN NOT (kg IS NOT NULL OR piece OR (core AND NOT {junked('wl')} AND len(wl) <= 2)) THEN 'no_package'
  WHEN NOT (len(sw) = 0 OR (slug_word IS NULL AND NOT {junked('sl')} AND (kg IS NOT NULL OR len(sl) <= 1))) THEN 'address'
  WHEN NOT (NOT {junked('tl')} AND (kg IS NOT NULL OR len(tl) <= 2)) THEN 'title' END AS reason FROM f)
SELECT item, offer_id, reason, CASE reason WHEN 'impostor' THEN raw_word WHEN 'warehouse_impostor' THEN view_word END AS word FROM r"""


@query(_sql())
def produce_decision(t):
    noun = F.when(F.col("p_partkey") % 5 == 4, "gear").otherwise(F.element_at(F.split("p_name", " ", 2), -1))
    named = t("part").withColumn("item", noun)
    offers = named.select("item", F.col("p_partkey").alias("offer_id"), *[F.expr(e.replace("{noun}", "item")).alias(c) for c, e in OFFER.items()], F.lit(None).cast("string").alias("size"), F.lit(None).cast("double").alias("parsed_kg"))
    items = named.select("item").distinct().select("item", *[F.expr(e).alias(c) for c, e in ITEM.items()]).select(
        "item", "category", F.array("item").alias("must_any"), F.lit(None).cast("array<string>").alias("must_all"), F.when(F.col("reject").isNotNull(), F.array("reject")).alias("rejects"),
        F.lit(None).cast("double").alias("each_grams"), F.col("max_kg").cast("double").alias("max_kg"), F.lit(None).cast("double").alias("pint_kg"),
    )
    return produce.product_reason(offers, items)
