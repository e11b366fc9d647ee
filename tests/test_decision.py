"""The identity decision on literals: every way and every reason."""

import pytest

from larder.operators import decision

ITEM = (
    "item string, label string, exact boolean, category string, form string, type string, variant string, must_all array<string>, must_any array<string>, must_not array<string>, "
    "preferred_id string, confirmed_id string, barcode string, text string"
)
OFFER = "item string, offer_id int, product_id string, name string, brand string, size string, upc string, url string, parsed_kg double, produce_reason string, handle string"


def decided(spark, cases, rules=decision.FORMS):
    items, offers = [], []
    for n, (item, offer, *_) in enumerate(cases):
        i, o = {"item": f"i{n}"} | item, {"name": "x"} | offer
        items.append(tuple(i.get(f.split()[0]) for f in ITEM.split(", ")))
        offers.append((i["item"], n, *(o.get(c) for c in ("product_id", "name", "brand", "size", "upc", "url", "kg", "produce")), "h"))
    got = decision.decide(spark.createDataFrame(offers, OFFER), spark.createDataFrame(items, ITEM), rules).collect()
    return [(r.way, r.reason) for r in sorted(got, key=lambda r: r.offer_id)]


EXACT = {"exact": True}
CASES = [
    (EXACT | {"confirmed_id": "SKU1", "must_any": ["milk"]}, {"product_id": "SKU1_EA", "name": "Tea"}, "confirmed", None),
    (EXACT | {"barcode": "0062715000013"}, {"upc": "062715000013", "name": "Tea"}, "barcode", None), (EXACT | {"preferred_id": "p"}, {"product_id": "p", "name": "Tea"}, "preferred", None),
    (EXACT | {"must_not": ["oat"], "type": "milk"}, {"name": "Oat milk"}, "rules", "must_not:oat"), (EXACT | {"must_all": ["skim", "2 l"], "type": "milk"}, {"name": "Milk"}, "rules", "must_all:skim"),
    (EXACT | {"must_any": ["milk", "cream"]}, {"name": "Juice"}, "rules", "must_any"), (EXACT | {"type": "milk", "must_any": ["dairy"]}, {"name": "Dairy drink"}, "rules", "other_type"),
    (EXACT | {"type": "milk"}, {"name": "Oil"}, "rules", "type:milk"), (EXACT | {"label": "Milk 2 l", "type": "milk"}, {"name": "Milk", "size": "500 ml"}, "rules", None),
    (EXACT | {"label": "Milk 2 l", "type": "milk"}, {"name": "Milk", "size": "300 ml"}, "rules", "size_ml"), (EXACT | {"label": "Rice 10 kg", "type": "rice"}, {"name": "Rice 2 kg"}, "rules", "size_kg"),
    (EXACT | {"label": "Rice 10 kg", "type": "rice"}, {"name": "Rice", "kg": 2.0}, "rules", "size_kg"), (EXACT | {"label": "Eggs large", "type": "eggs"}, {"name": "Eggs extra large"}, "rules", "large_not_extra_large"),
    (EXACT | {"label": "Eggs", "must_not": ["Free Run eggs"], "type": "eggs"}, {"name": "Free run white eggs"}, "rules", "free_run"),
    (EXACT | {"label": "Lactantia butter", "preferred_id": "p"}, {"product_id": "q", "name": "Butter"}, "rules", "other_brand"),
    (EXACT | {"label": "Lactantia butter", "preferred_id": "p"}, {"product_id": "q", "name": "Butter", "brand": "Lactantia"}, "rules", None),
    ({"category": "produce", "must_any": ["tomato"]}, {"name": "Canned tomatoes"}, "rules", "fresh_not_canned"), ({"form": "Fresh", "type": "tomato"}, {"name": "Tomato paste"}, "rules", "fresh_not_processed"),
    ({"form": "fresh"}, {"name": "Frozen peas"}, "rules", "fresh_not_frozen"), ({"item": "tomato", "category": "produce"}, {"name": "Tomatoes 398 ml"}, "rules", "fresh_not_canned"),
    ({"category": "frozen"}, {"name": "Fresh peas"}, "rules", "frozen_not_fresh"), ({"category": "frozen"}, {"name": "Fresh frozen peas"}, "rules", None),
    ({"label": "White quinoa"}, {"name": "Red quinoa"}, "rules", "white_quinoa"), ({"label": "White quinoa"}, {"name": "Red and white quinoa"}, "rules", None),
    ({"variant": "rectangular"}, {"name": "Round lid"}, "rules", "rectangular_not_round"), ({"variant": "round"}, {"name": "Rectangular lid"}, "rules", "round_not_rectangular"),
    ({"category": "produce"}, {"name": "Lemon", "produce": "title"}, "rules", "produce"), ({"category": "dairy"}, {"name": "Lemon", "produce": "title"}, "rules", None),
    ({"category": "frozen", "must_all": ["frozen"]}, {"name": "Peas IQF"}, "rules", None), ({"category": "produce", "must_all": ["red pepper"]}, {"name": "VEGETABLES - PEPPERS RED"}, "rules", None),
    (EXACT | {"must_all": ["red pepper"]}, {"name": "Peppers red"}, "rules", "must_all:red pepper"), ({}, {"name": None}, "rules", None), (EXACT, {"name": None}, "rules", None),
]


def test_every_way_and_reason(spark):
    assert decided(spark, CASES) == [tuple(c[2:]) for c in CASES]
    grape = ({"item": "tomato", "form": "fresh"}, {"name": "Tomatoes", "url": "https://shop.example/en/grape-tomatoes/p/1"})
    assert decided(spark, [grape]) == [("rules", "fresh_not_grape")]


@pytest.mark.parametrize("unless,reason", [(None, "no_decaf"), (r"\bhalf\b", None)])
def test_rules_are_rows(spark, unless, reason):
    rule = decision.Rule("type", "^coffee$", r"\bdecaf\b", unless, "no_decaf")
    assert decided(spark, [({"type": "coffee"}, {"name": "Half decaf coffee"})], [rule]) == [("rules", reason)]


def test_empty_and_unknown(spark):
    items, offers = spark.createDataFrame([], ITEM), spark.createDataFrame([("i", 1, *[None] * 9)], OFFER)
    assert decision.decide(offers, items).count() == 0
