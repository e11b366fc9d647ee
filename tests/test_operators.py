"""The reference's semantics on literals, and every registered query against its SQL."""

import collections
import glob
import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.functions import money, text, units
from larder.operators import basket, compare, costing, identity, quality, receipts
from larder.plans import catalogue
from larder.sources import payloads
from larder.streaming import prices

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return collections.Counter(tuple(v[i] for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in con.description]
    found = catalogue.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, con.fetchall())


@pytest.mark.parametrize("x,want", [(1.005, 1.0), (-2.5, -2.5), (2.675, 2.68), (-0.005, 0.0)])
def test_money_rounds_half_up_on_the_binary_value(spark, x, want):
    assert one(spark, money.r2(F.lit(x))) == want


def test_packs_needed_has_slack_and_is_one_at_least(spark):
    need = [(1.0, 0.5, 2), (1.0000000001, 0.5, 2), (0.0, 0.5, 1), (1.1, 0.5, 3)]
    for n, p, want in need:
        assert one(spark, money.packs_needed(F.lit(n), F.lit(p))) == want


ITEMS = ["milk", "eggs", "chicken", "oil", "bananas"]
SHELF = {"walmart": [6.47, 4.88, 13.97, 9.97, 1.74], "no_frills": [6.44, 4.49, 11.99, 9.49, 1.54], "sobeys": [6.99, 5.29, 14.99, 8.99, 1.99]}


def test_fixture_basket(spark):
    offers = spark.createDataFrame([(i, s, p) for s, ps in SHELF.items() for i, p in zip(ITEMS, ps)], "item string, store string, price double")
    lines = spark.createDataFrame([(1, i, 1.0) for i in ITEMS], "cart int, item string, quantity double")
    priced = basket.priced_lines(lines, basket.best_offers(offers))
    totals = basket.coverage(lines, priced)
    assert {r.store: r.total for r in totals.collect()} == {"walmart": 37.03, "no_frills": 33.95, "sobeys": 38.25}
    assert basket.winner(totals).first().winner == "no_frills"
    assert round(sum(r.subtotal for r in basket.mixed(priced).collect()), 2) == 33.45
    short = offers.where("not (store = 'no_frills' and item = 'eggs')")
    got = {r.store: r.total for r in basket.coverage(lines, basket.priced_lines(lines, basket.best_offers(short))).collect()}
    assert got["no_frills"] is None and got["walmart"] == 37.03  # a missing price is never zero


def test_procurement_cost(spark):
    assert one(spark, basket.procurement_cost(F.lit(100.0), F.lit(2))) == 128.0


@pytest.mark.parametrize("a,b,want", [((2.97, 0.283), (7.99, 0.907), ("per_100g", "b")), ((7.96, 0.454), (8.29, 0.454), ("per_pack", "a")), ((3.93, 1.0), (3.93, 1.0), ("per_pack", "tie")),
                                      ((10.24, 2.63), (8.99, 1.36), ("per_100g", "a")), ((3.0, None), (4.0, 1.0), ("incomparable", None)), ((None, 1.0), (4.0, 1.0), ("incomparable", None))])
def test_fair_compare(spark, a, b, want):
    lit = lambda x: F.lit(x).cast("double")
    r = one(spark, compare.fair_compare([("a", lit(a[0]), lit(a[1])), ("b", lit(b[0]), lit(b[1]))]))
    assert (r.basis, r.cheaper) == want


@pytest.mark.parametrize("title,volume,purchase", [("4 x 250 g", 1.0, 1.0), ("2.63 L juice", 2.63, None), ("grapes 907g", 0.907, 0.907), ("$3.49/100g 250 ml", 0.25, None), ("none", None, None), ("2 lb 500 g", 0.90718474, 0.90718474)])
def test_masses(spark, title, volume, purchase):
    near = lambda x, y: x == y or abs(x - y) < 1e-9
    assert near(one(spark, units.parse_mass_kg(F.lit(title))), volume) and near(one(spark, units.parse_mass_kg(F.lit(title), volume=False)), purchase)


@pytest.mark.parametrize("title,want", [("tomatoes 15 lb case", "case"), ("12 x 1 pint berries", "case"), ("bag of carrots 2 lb", "fixed_pack"), ("bananas per kg", "loose_weight"), ("onions", "loose_weight"), ("rice 2 kg", "fixed_pack")])
def test_sale_modes(spark, title, want):
    assert one(spark, units.sale_mode(F.lit(title), F.lit(True))) == want


def test_names(spark):
    assert one(spark, text.name_tokens(F.lit("Mom's Ripe Tomatoes 500g (Pack of 2%) Berries"))) == ["mom", "ripe", "tomato", "500", "g", "2pct", "berry"]
    assert one(spark, text.brands_match(F.lit("Coca-Cola"), F.lit("coca cola"))) == "exact"
    assert one(spark, text.brands_match(F.lit("PC"), F.lit("PC Organics"))) == "mismatch"
    assert one(spark, text.brands_match(F.lit(None).cast("string"), F.lit("x"))) == "missing"
    assert one(spark, text.normalize_upc(F.lit("00-1234 56789"))) == "123456789" and one(spark, text.normalize_upc(F.lit("123"))) is None
    assert one(spark, units.convert(F.lit(1.0), F.lit("kg"), F.lit("ml"))) is None and one(spark, units.convert(F.lit(2.0), F.lit("l"), F.lit("ml"))) == 2000.0


def test_scores(spark):
    score = lambda *a: one(spark, identity.structured_score(*map(F.lit, a)))
    assert score(1.0, "exact", "same", True) == 1.0 and score(0.9, "missing", "unknown", True) == 0.9
    assert abs(score(1.0, "exact", "different", True) - 0.5) < 1e-9  # the cap comes before the category
    assert one(spark, identity.decision(F.lit(0.8496))) == "auto_linked" and one(spark, identity.decision(F.lit(0.4))) == "rejected"


def test_costing(spark):
    plan = one(spark, costing.needed_weight(F.lit(2.99), F.lit(283.0), F.lit(550.0)))
    assert (plan.packs, plan.in_range) == (2, True)
    cover = one(spark, costing.needed_weight(F.lit(12.0), F.lit(2000.0), F.lit(550.0)))
    assert (cover.packs, cover.in_range, cover.total) == (1, False, 12.0)


def test_receipts(spark):
    t = "2 @ MILK 2% 4L  6.47\nSUBTOTAL 6.47\nHST 0.84\nBANANAS | 1.54 D\n***\nTOTAL 8.85\n"
    got = receipts.parse_lines(spark.createDataFrame([(1, t), (2, None), (3, "")], "receipt_id int, text string")).collect()
    assert [(r.name, r.qty, r.price) for r in got] == [("MILK 2% 4L", 2.0, 6.47), ("BANANAS", None, 1.54)]


def test_payloads(spark, tmp_path):
    tile = '[{"productId":"1","title":"Milk","pricing":{"price":"6.44"},"pricingUnits":{"weighted":true}},{"productId":"2","title":"Tea","pricing":{"price":"n/a"}}]'
    got = payloads.tile_offers(spark.createDataFrame([(tile,), (None,), ("{",)], "payload string")).collect()
    assert [(r.product_id, r.price, r.by_weight) for r in got if r.product_id] == [("1", 6.44, True), ("2", None, False)]
    shop = '{"checkedAt":"2026-01-01T00:00:00Z","products":[{"id":"7","title":"Jam","variants":[{"available":true,"price":"3.50"},{"available":false,"price":"1"}]}]}'
    assert [(r.product_id, r.price) for r in payloads.shop_offers(spark.createDataFrame([(shop,)], "payload string")).collect()] == [("7", 3.5)]
    (tmp_path / "r.csv").write_text("date,store,upc,name,qty\n2026-01-02,s,00123,Milk,x\n")
    r = payloads.receipts_csv(spark, str(tmp_path)).first()
    assert (r.upc, r.qty, r.product_id) == ("00123", None, None)
    assert one(spark, payloads.json_field(F.lit("{bad"), "$.k", "int")) is None


def test_upsert_and_overlay(spark):
    base = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 5)], "item string, price double, ts int")
    new = spark.createDataFrame([("a", 9.0, 1), ("b", 8.0, 4), ("c", 7.0, 1)], "item string, price double, ts int")
    assert sorted((r.item, r.price) for r in payloads.upsert(base, new, ["item"], "ts").collect()) == [("a", 9.0), ("b", 2.0), ("c", 7.0)]
    over = spark.createDataFrame([("a", None, 3), ("z", 1.0, None)], "item string, price double, ts int")
    assert sorted(tuple(r) for r in quality.overlay(base, over, "item").collect()) == [("a", 1.0, 3), ("b", 2.0, 5), ("z", 1.0, None)]


def test_stream_keeps_the_last_known_price(spark, tmp_path):
    schema = "id long, item string, price double, ts timestamp"
    data = lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    data([(1, "a", 1.0, datetime(2026, 1, 1)), (2, "b", None, datetime(2026, 1, 1))])
    run = lambda: prices.keep_last_known(prices.observed(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    data([(3, "a", 2.0, datetime(2026, 1, 2)), (4, "b", 5.0, datetime(2025, 1, 1))])
    run()
    assert sorted((r.item, r.price) for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()) == [("a", 2.0), ("b", 5.0)]


def test_baskets_of_offered_lines_equal_those_of_priced_lines(spark, monkeypatch):
    lines = spark.createDataFrame([(c, i, float(c % 3 + 1)) for c in range(12) for i in (0, 1, c % 5, 9 if c % 4 == 0 else 2)] + [(1, None, 1.0), (None, 1, 2.0)], "cart long, item long, quantity double")
    offers = spark.createDataFrame([(i, s, 1.0 + (i * 7 + s * 3) % 5) for i in range(6) for s in range(4) if (i + s) % 3], "item long, store long, price double")
    best = basket.best_offers(offers)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    offered, priced = basket.offered_lines(lines, best), basket.priced_lines(lines, best)
    assert rows(basket.coverage_of(offered)) == rows(basket.coverage(lines, priced)) and basket.coverage_of(offered).where("total is null").count() > 0
    assert rows(basket.mixed_of(offered)) == rows(basket.mixed(priced))
    plan = basket.winner(basket.coverage_of(offered))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # lines and offers are read once each
    monkeypatch.setattr(basket, "TASK_ROWS", 4)
    assert basket.offered_lines(lines, best).rdd.getNumPartitions() == 13  # 50 rows
