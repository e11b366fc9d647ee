"""The comparison row and the matches of receipt lines on literals and against all pairs."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.operators import plans, receipts, rows
from larder.plans import catalogue
from larder.plans import rows as row_queries  # noqa: F401  registers compare_rows

STORES = ["walmart", "nofrills", "wholesaleclub", "mvr"]
RETAILER = dict(zip(STORES, ("walmart_ca", "no_frills", "wholesale_club", "mvr")))
ITEM = (
    "item string, weighed boolean, produce boolean, cheapest boolean, egg boolean, supplies boolean, rejected boolean, strategy string, unit string, default_amount double, "
    "maximum double, percent double, each_grams double, grams double, qty double, requested double, preferred_id string, upc_hit boolean, price int, o string"
)
OFFER = "item string, store string, product_id string, name string, size string, price double, parsed_kg double, retailer string, ok boolean, identity_reason string, status string, need int"


def row(spark, offers, **item):
    given = {"item": "i", "strategy": "exact_need", "unit": "ea", "percent": 15.0} | item
    names = [f.split()[0] for f in ITEM.split(", ")]
    items = spark.createDataFrame([tuple(given.get(n) for n in names)], ITEM)
    made = [("i", s, f"p-{s}", o["name"], o.get("size"), o["price"], o.get("kg"), RETAILER[s], o.get("ok", True), o.get("reason"), "ok", 1) for s, o in offers.items()]
    (r,) = rows.compare_rows(items, spark.createDataFrame(made, OFFER), STORES).collect()
    return r


def test_packs_of_different_size_cover_the_largest(spark):
    big = {"name": "Grape tomatoes", "size": "907 g", "price": 7.99}
    r = row(spark, {"walmart": {"name": "Red Grape Tomato - 283g", "size": "283 g", "price": 2.44, "kg": 0.283}, "nofrills": big, "wholesaleclub": big, "mvr": {"name": "Grape pint", "price": 1.99, "kg": 0.34}}, cheapest=True, produce=True)
    assert (r.basis, r.label, r.requested, r.requested_unit, r.grams) == ("needed_weight", "grams_of_different_packs", 907.0, "g", 907.0)
    assert (r.packs_walmart, r.packs_nofrills, r.packs_mvr) == (3, 1, 3)
    assert (r.basket_walmart, r.basket_nofrills, r.basket_mvr, r.cheaper, r.delta) == (7.32, 7.99, 5.97, "mvr", -1.35)
    alike = row(spark, {"walmart": {"name": "A 283 g", "price": 3.0}, "nofrills": {"name": "B 290 g", "price": 2.0}}, cheapest=True)
    assert (alike.label, alike.requested, alike.basis, alike.cheaper) == ("checkout", 1.0, "per_pack", "nofrills")


def test_loose_against_packs(spark):
    r = row(
        spark, {"walmart": {"name": "Tomatoes", "size": "$5.49/1kg $2.49/1lb", "price": 3.9}, "nofrills": {"name": "Tomato Beefsteak 5Lb", "size": "1 ea, $999.00/100ea", "price": 9.99}},
        cheapest=True, produce=True, unit="kg", default_amount=2.0, grams=2000.0, requested=2.0,
    )
    assert (r.basket_walmart, r.basket_nofrills, r.cheaper) == (10.98, 9.99, "nofrills")


def test_stock_is_compared_at_the_amount_of_the_best_unit(spark):
    offers = {"walmart": {"name": "Orange Juice 1 L bottle", "price": 5.0}, "wholesaleclub": {"name": "Orange Juice 2 L bottle", "price": 9.0}}
    r = row(spark, offers, strategy="stock_up", unit="l", default_amount=1.0, maximum=2.0, supplies=True)
    assert (r.got_wholesaleclub, r.cheaper, r.delta, r.label) == (2.0, "wholesaleclub", -1.0, "stock_up")


def test_rejected_other_products_and_no_offers(spark):
    offers = {"walmart": {"name": "Oat milk", "price": 5.0}, "nofrills": {"name": "Milk", "price": 4.0, "reason": "form"}, "mvr": {"name": "Milk", "price": 4.5, "ok": False}}
    r = row(spark, offers, rejected=True)
    assert (r.basis, r.label, r.cheaper, r.delta, r.basket_nofrills, r.status_nofrills, r.status_wholesaleclub) == ("incomparable", "different_products", "incomplete", None, None, "form", "no_match")
    assert row(spark, offers, rejected=True, cheapest=True).label == "checkout"
    assert row(spark, {}).cheaper == "incomplete" and row(spark, {}).match_kind == "fuzzy"
    assert row(spark, offers, upc_hit=True).match_kind == "upc" and row(spark, offers, preferred_id="p-walmart").match_kind == "preferred_sku"


def test_butter_of_a_locked_sku_without_a_size(spark):
    r = row(spark, {"walmart": {"name": "Unsalted Butter", "price": 7.96}, "nofrills": {"name": "Unsalted Butter", "size": "454 g", "price": 8.29, "kg": 0.454}}, preferred_id="p-walmart")
    assert (r.basket_walmart, r.basket_nofrills, r.match_kind) == (7.96, 8.29, "preferred_sku")


def test_the_first_of_the_smallest_stops_counts(spark):
    rows_ = [("c", 0, 1.0, 2.0), ("c", 1, 3.0, 2.0)]
    got = {r.plan: r for r in plans.recommend(spark.createDataFrame(rows_, "cart string, ord int, a double, b double"), ["a", "b"]).collect()}
    assert (got["a+b"].total, got["a+b"].saving, got["a+b"].recommended) == (3.0, 1.0, True)
    # two lines in one store and one, which the main store has too, in the other: 1.00 is too little
    rows_ = [("c", 0, 1.0, 9.0), ("c", 1, 1.0, 9.0), ("c", 2, 3.0, 2.0)]
    assert {r.plan for r in plans.recommend(spark.createDataFrame(rows_, "cart string, ord int, a double, b double"), ["a", "b"]).collect()} == {"a"}


def plain_match(name, items):
    """The rule, item by item."""
    strip = lambda t: re.sub(r"\s+", " ", re.sub(r"(?i)\b\d+\s*x\s*\d+\b", " ", re.sub(r"(?i)\b\d+([.,]\d+)?\s*(l|lt|ml|kg|g|oz|lb|lbs|ct|pk|pack|dozen|doz)\b", " ", t))).strip()
    name = name.strip()
    short = strip(name) or name
    eggs = lambda q: bool(re.search(r"\beggs?\b", q.lower())) and "eggplant" not in q.lower()
    if eggs(name) or eggs(short):
        return next((i for i, _ in items if i == "large_eggs_dozen"), None)

    def holds(hay, q):
        parts = [p for p in q.split() if len(p) >= 2]
        word = lambda p: re.search(rf"(^|[^a-z0-9]){re.escape(p)}(?:es|s)?([^a-z0-9]|$)", hay)
        return q in hay or (len(parts) > 1 and all(p in hay for p in parts)) or (len(q.split()) > 1 and all(map(word, q.split())))

    def points(item, label, q):
        return 100 if label.lower() == q else 80 if label.lower().startswith(q) else 60 if q in label.lower() else 40 if q in item.replace("_", " ") else 20

    hits = []
    for item, label in items:
        hay = re.sub(r"\s+", " ", f"{label} {item.replace('_', ' ')}".lower()).strip()
        if holds(hay, short.lower()) or holds(hay, name.lower()):
            hits.append((-max(points(item, label, short.lower()), points(item, label, name.lower())), label.lower(), label, item))
    if not hits:
        return None
    best = min(hits)
    words = [w for w in strip(name).split() if len(w) >= 4 and not re.fullmatch(r"(?i)\d+([.,]\d+)?(l|lt|ml|kg|g|oz|lb|lbs|ct|pk|pack|dozen|doz)?|\d+x\d+([.,]\d+)?", w)]
    return best[3] if best[0] <= -40 or (words and all(w.lower() in f"{best[2]} {best[3]}".lower() for w in words)) else None


def test_receipt_names_against_all_items(spark):
    r = random.Random(6)
    words = ["milk", "xl", "ab", "oat", "c", "vitamin", "green", "beans", "2%", "xl7", "a", "fancy", "tomatoes", "tomato", "k2"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(f"id_{i}", some(r.randrange(1, 4)).title() if i % 2 else some(r.randrange(1, 4))) for i in range(40)] + [("ab", "ab"), ("m", "milk xl7"), ("vit", "Vitamin D and C")]
    names = {some(r.randrange(1, 4)) + r.choice(["", " 2 kg", " 12 x 3", " 500g"]) for _ in range(150)} | {"xl milk", "ab", "vitamin c", "eggs large", "eggplant", "x", "2 kg", " milk "}
    for catalogue in (items, [*items, ("large_eggs_dozen", "Large eggs")]):
        df = receipts.match_lines(spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("  ",)], "name string"), spark.createDataFrame(catalogue, "id string, label string"))
        found = {x.name: x.id for x in df.collect()}
        assert found == {n: m for n in names if (m := plain_match(n, catalogue)) is not None}
    assert found["xl milk"] and found["ab"] and found["vitamin c"] and found["eggs large"] == "large_eggs_dozen"


@pytest.mark.parametrize("kgs,qty,cover", [([0.283, 0.907], 1, 907), ([0.283, 0.29], 1, None), ([0.283, 0.907, None], 2, 1814), ([0.3], 1, None), ([None, 0.0, 0.5], 1, None)])
def test_shared_cover(spark, kgs, qty, cover):
    values = F.array(*[F.lit(k).cast("double") for k in kgs])
    assert spark.range(1).select(rows.shared_cover(values, F.lit(float(qty))).alias("x")).first().x == cover


def test_a_part_of_sixty_grams_is_one_piece_as_in_the_sql(spark, tmp_path):
    spark.range(80).selectExpr("id as p_partkey", "'cold gear' as p_name", "if(id % 40 < 20, 3, 6) as p_size", "900 + id % 7.0 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE["compare_rows"])
    names = [c[0] for c in want.description]
    made = catalogue.QUERIES["compare_rows"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, made.collect()), key=lambda r: r[0]) == sorted(want.fetchall(), key=lambda r: r[0])
