"""The rules of units, costing, identity, offers, plans and receipts on literals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import text, units
from larder.operators import costing, identity, offers, plans, receipts, resolve, verdicts
from larder.sources import payloads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


def each(spark, f, cases, kind="string"):
    """f over a column of the cases' inputs, in one query."""
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, t {kind}").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [(c, r.x) for (c, _), r in zip(cases, rows)]


def test_masses_counts_and_rates(spark):
    masses = [("12 x 250 ml", 3.0), ("1 x 2 kg", 2.0), ("$7.69/1kg $3.49/1lb", 1.0), ("1,000 g", 1.0), ("500gr 2 lt", 2.0), ("$3.49/100g 250 ml", 0.25), ("16 oz", units.KG_PER_LB), ("no", None), (None, None), ("/100g", 0.0)]
    got = each(spark, lambda t: units.parse_mass(t)["kg"], masses)
    # the third has a rate alone: the amount that is joined to its unit stands behind a slash, so a digit of it is read, or nothing
    assert [x for c, x in got if not (c or "").startswith("$7.69")] == pytest.approx([w for c, w in masses if not (c or "").startswith("$7.69")])
    kgs = [("2 x 500 g", 1.0), ("250 ml", None), ("$4/100 g 300 g", 0.3), ("3 ounces", 3 / 16 * units.KG_PER_LB)]
    assert [x for _, x in each(spark, units.parse_amount, kgs)] == pytest.approx([w for _, w in kgs])
    counts = [("15x1 DOZ", (12, 15, 180)), ("10x18EA", (18, 10, 180)), ("30 ea, $0.58/1ea", (30, 1, 30)), ("1DOZ", (12, 1, 12)), ("8 pack", (8, 1, 8)), ("tray of 24", (24, 1, 24)), ("4 pack", None), (None, None)]
    assert [x and tuple(x) for _, x in each(spark, units.count_pack, counts)] == [w for _, w in counts]
    rates = one(spark, units.embedded_rates(F.lit("$7.69/1kg $3.49/1lb 8/kg")))
    assert (rates.per_kg, rates.per_lb) == (8.0, 3.49)


def test_sale_modes(spark):
    modes = [("Berries 12 × 1 pint", "case"), ("Onions 3 / lb", "loose_weight"), ("Onions bag per kg", "fixed_pack"), ("Grapes $4.99/kg", "loose_weight"), ("Tea 100 g", "fixed_pack"), ("Plums", "loose_weight")]
    assert [x for _, x in each(spark, lambda t: units.sale_mode(t, F.lit(True)), modes)] == [w for _, w in modes]


def test_unit_prices(spark):
    offer = lambda i, n, s, r, p, u=None: units.unit_prices(lit(i), lit(n), lit(s), lit(r), lit(p, "double"), lit(u, "double"))
    assert tuple(one(spark, offer("1", "Apples", "$7.69/1kg", "walmart", 3.0))) == (7.69, 3.49, "kg", 7.69, "embedded_rate")
    assert tuple(one(spark, offer("2_LB", "Apples", None, "no_frills", 2.0)))[3:] == (2.0, "sold_by_lb")
    assert tuple(one(spark, offer("3", "Rice", "2 kg", "walmart", 8.0, 900.0)))[3:] == (4.0, "pack_2kg")
    assert one(spark, offer("4", "Rice", None, "walmart", 8.0)) is None
    total = one(spark, units.price_for_mass(F.lit(0.5), lit("5"), lit("Plums"), lit(None), lit("walmart"), lit(4.0, "double"), lit(None, "double")))
    assert tuple(total) == (2.0, 4.0, "sold_by_kg")


def plan(spark, name, price, unit="g", need=500.0, strategy="exact_need", maximum=None, percent=15.0, per_kg=None, weighed=False):
    offer = {"name": lit(name), "size": lit(None), "price": lit(price, "double"), "per_kg": lit(per_kg, "double"), "parsed_kg": lit(None, "double"), "by_weight": lit(weighed, "boolean")}
    return one(spark, costing.evaluate_purchase(offer, lit(unit), lit(strategy), lit(need, "double"), lit(maximum, "double"), lit(percent, "double")))


def test_purchases(spark):
    loose = plan(spark, "Tomato per kg", 4.0, per_kg=4.0, weighed=True)
    assert (loose.valid, loose.total, loose.got) == (True, 2.0, 500.0)
    near = plan(spark, "Tomato 470 g pack", 3.0)
    assert (near.valid, near.packs, near.total) == (True, 1, 3.0)
    assert not plan(spark, "Tomato 2 kg bag", 3.0).valid and plan(spark, "Tomato 2 kg bag", 3.0).total is None
    over = plan(spark, "Tomato 470 g pack", 3.0, strategy="stock_up", maximum=600.0)
    assert (over.valid, over.total, over.reason) == (False, None, costing.NO_PACK)
    more = plan(spark, "Tomato 250 g pack", 1.0, strategy="stock_up", maximum=1000.0)
    assert (more.valid, more.packs, more.total) == (True, 2, 2.0)
    assert plan(spark, "Tomato 250 g pack", 1.0, strategy="stock_up").reason == costing.NO_MAXIMUM
    eggs = plan(spark, "Eggs 30 ea tray", 9.0, unit="ea", need=28.0)
    assert (eggs.valid, eggs.packs, eggs.got) == (True, 1, 30.0)
    assert plan(spark, "x", 0.0).reason == costing.NO_MATCH and plan(spark, "Oil", 4.0).reason == costing.NO_PACK


RECORDS = "id int, retailer string, product_id string, name string, brand string, size_value double, size_unit string, category string, barcode string"


def matched(spark, a, b, maps=()):
    rows = identity.prepared(spark.createDataFrame([(0, "p", "1", *a), (1, "q", "2", *b)], RECORDS))
    pairs = rows.where("id = 0").select(F.struct("*").alias("left")).crossJoin(rows.where("id = 1").select(F.struct("*").alias("right")))  # one row each
    saved = spark.createDataFrame(list(maps), "left_retailer string, left_id string, right_retailer string, right_id string, verified boolean")
    return identity.match_products(pairs, saved).first()["match"]


def test_matching(spark):
    milk = ("Organic Oat Milk 2% 1 L", "Acme", 1.0, "l", "dairy", None)
    assert matched(spark, milk, milk).method == "structured"
    code = ("a", None, None, None, None, "0012345678905")
    assert tuple(matched(spark, code, ("b", None, None, None, None, "12345678905")))[:3] == ("upc", 1.0, "auto_linked")
    almond = ("Organic Almond Milk 2% 1 L", "Acme", 1.0, "l", "dairy", None)
    apart = matched(spark, milk, almond)
    assert apart.decision != "auto_linked" and apart.reason == "oat vs almond"
    assert matched(spark, milk, (*milk[:2], 2.0, *milk[3:])).decision != "auto_linked"
    assert matched(spark, milk, almond, [("q", "2", "p", "1", True)]).method == "manual_mapping"
    other = (*milk[:5], "99999999999")
    assert matched(spark, (*milk[:5], "11111111111"), other).decision == "needs_review"
    assert one(spark, identity.brand_tokens(F.lit("Great Value"))) == ["great", "value", "gv"]
    assert one(spark, identity.conflict(text.name_tokens(F.lit("decaf coffee")), text.name_tokens(F.lit("coffee")))) == "decaf vs caffeinated"


def test_candidate_pairs_drop_no_partner(spark):
    rows = [(i, f"n{i % 3}", f"b{i % 2}", i % 4) for i in range(40)]
    got = identity.candidate_pairs(spark.createDataFrame(rows, "id int, name string, brand string, size int"), "id", [["name", "brand"], ["name", "size"]])
    found = [(r.left.id, r.right.id) for r in got.collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[2] == b[2] or a[3] == b[3])}
    assert len(found) == len(set(found)) and set(found) == want


def test_off_by_one_ids(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = identity.off_by_one_join(ids("123456", "999999", "12345", "100000", "ab"), ids("123457", "123456", "1000000", "12346", "099999", "99999", "ab", None)).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [("100000", "099999"), ("123456", "123456"), ("123456", "123457"), ("ab", "ab")]


def test_filters(spark):
    words = lambda *w: F.array(*map(F.lit, w))
    reason = lambda hay, ban=None, every=None, some=None, split=False: one(spark, offers.filter_reason(F.lit(hay), *[lit(None, "array<string>") if x is None else words(*x) for x in (ban, every, some)], F.lit(split)))
    assert reason("seedless grapes", ["seed"]) is None and reason("waffles", ["waffle"]) == "mustNotInclude:waffle"
    assert reason("tomatoes grape", every=["grape tomatoes"]) == "mustIncludeAll:grape tomatoes" and reason("tomatoes grape", every=["grape tomatoes", "2.63L"], split=True) is None
    assert reason("rice", some=["oats", "5x1"]) == "mustIncludeAny" and reason("rice", some=["5x1"]) is None and reason("a.b", ["a.b"]) == "mustNotInclude:a.b"


def test_match_to_a_query(spark):
    s = lambda name, q, price=5.0, exact=False: one(spark, offers.score_match(lit(name), lit(None), lit(None), lit(price, "double"), lit(exact, "boolean"), lit(False, "boolean"), lit(q)))
    assert s("Kosher 2% Milk 2L", "kosher 2% milk 2l", exact=True) == pytest.approx(12.0)
    assert s("Chocolate milk", "milk") is None and s("Milk", "oat milk") is None and s("Milk", "2 l") is None and s("Milk", "milk", 0.0) is None
    assert s("Milk", "milk", 50.0) == 9.0


def test_sanity_and_small_rules(spark):
    def status(size, price, expected, compose=False, least=None, most=None, age=None, jug=False):
        offer = {"name": lit("Milk"), "size": lit(size), "price": lit(price, "double"), "unit_price": lit(None, "double"), "age_hours": lit(age, "double")}
        return one(spark, offers.sanity(offer, lit(expected, "double"), lit(compose, "boolean"), lit(least, "double"), lit(most, "double"), lit(jug, "boolean"), F.lit(False)))["status"]

    assert status("200 ml", 3.0, 2.63) == "wrong_size" and status("1.36 l", 3.0, 2.63) == "ok" and status("500 g", 3.0, 1.0, True, least=5.0) == "ok"
    assert status("100 g", 3.0, 1.0, True) == "wrong_size" and status("1 kg", 0.0, 1.0) == "rejected" and status("1 kg", 1.0, 1.0, least=2.0) == "wrong_pack"
    assert status("300 ml", 3.0, None, jug=True) == "wrong_pack" and status("1 kg", 3.0, 1.0, age=25.0) == "stale"
    assert one(spark, offers.merge_keywords(F.array(lit("Oat "), lit("")), lit(None, "array<string>"), F.array(lit("oat"), lit("Rice")))) == ["Oat", "Rice"]
    assert one(spark, offers.parse_money(lit("CA$1.2.3"))) == 1.2 and one(spark, offers.barcodes(lit("x 0012345678 and 12345678"))) == ["12345678"]
    assert one(spark, offers.map_availability(lit("Out of stock"))) == "out_of_stock" and one(spark, offers.on_shelf(lit(None)))
    assert tuple(one(spark, offers.delivery_spread(F.lit(10.0), F.lit(11.0)))) == (10.0, "delivery_higher")
    assert one(spark, units.numeric_alias_ids(lit("100"))) == ["100", "99", "101"] and one(spark, offers.strip_pack_noise(lit("Juice 2.63L 5x1"))) == "Juice"


STORES = ["walmart", "nofrills", "wholesaleclub", "mvr"]


def recommended(spark, lines):
    rows = [("c", i, *[x.get(s) for s in STORES]) for i, x in enumerate(lines)]
    return {r.plan: r for r in plans.recommend(spark.createDataFrame(rows, "cart string, ord int, " + ", ".join(f"{s} double" for s in STORES)), STORES).collect()}


def test_plans(spark):
    costs = lambda *v: dict(zip(STORES, v))
    split = recommended(spark, [costs(10.0, 11.0, 4.0, 12.0), costs(10.0, 11.0, 4.0, 12.0), costs(5.0, 8.0, 9.0, 9.0)])
    two = split["walmart+wholesaleclub"]
    assert (two.kind, two.recommended, two.total) == ("split_cheaper", True, 13.0) and two.saving > 0.5
    tiny = recommended(spark, [costs(4.0, 5.0, 3.8, 6.0), costs(7.0, 9.0, 8.0, 10.0), costs(5.0, 6.0, 6.0, 7.0)])
    assert all(r.n_stops == 1 for r in tiny.values()) and tiny["walmart"].recommended
    gap = recommended(spark, [costs(4.0, 5.0, None, 6.0), costs(None, None, 3.0, None), costs(5.0, 6.0, 7.0, 8.0)])
    best = next(r for r in gap.values() if r.recommended)
    assert (best.plan, best.kind, best.filled) == ("walmart+wholesaleclub", "split_fill", 3)
    assert recommended(spark, [costs(1.0, None, None, None), costs(None, 1.0, None, None), costs(None, None, 1.0, 0.0)])["walmart+nofrills+wholesaleclub"].recommended
    # the tie on the third line goes to the store with more lines so far
    tie = {r.plan: r for r in plans.cart_plans(spark.createDataFrame([("c", 0, None, 1.0), ("c", 1, 9.0, 1.0), ("c", 2, 2.0, 2.0), ("c", 3, 1.0, 5.0)], "cart string, ord int, a double, b double"), ["a", "b"]).collect()}
    assert {m.ord: m.store for m in tie["a+b"].made} == {0: "b", 1: "b", 2: "b", 3: "a"}


def plain_plan(lines, names):
    """The lines of a cart in the order of their assignment, (ord, store, cost), by the rule line by line."""
    has = [[s for s in names if x[s] is not None and x[s] > 0] for x in lines]
    n, made = dict.fromkeys(names, 0), []
    for i in [i for i, h in enumerate(has) if len(h) == 1] + [i for i, h in enumerate(has) if len(h) > 1]:
        store, cost = has[i][0], lines[i][has[i][0]]
        for s in has[i][1:]:
            if lines[i][s] < cost - 0.005:
                store, cost = s, lines[i][s]
            elif abs(lines[i][s] - cost) < 0.005 and n[s] > n[store]:
                store = s
        n[store] += 1
        made.append((i, store, cost))
    return made, n


def test_plans_of_many_carts_are_made_in_batches(spark):
    """Ties, gaps and stores not in the order of their names, over batches and slices of them; no fold over expressions is left in the plan."""
    r, names = random.Random(5), ["d", "b", "c"]
    carts = [[{s: r.choice([1.0, 1.0, 1.004, 1.008, 2.0, 0.1 * i, None, 0.0]) for s in names} for i in range(r.choice([1, 3, 9]))] for _ in range(300)]
    rows = [(c, i, *[x[s] for s in names]) for c, lines in enumerate(carts) for i, x in enumerate(lines)]
    made = plans.cart_plans(spark.createDataFrame(rows, "cart long, ord int, d double, b double, c double"), names)
    got = {(x.cart, x.plan): x for x in made.collect()}
    want = 0
    for c, lines in enumerate(carts):
        for own in [["d"], ["b"], ["c"], ["d", "b"], ["d", "c"], ["b", "c"], ["d", "b", "c"]]:
            assigned, n = plain_plan(lines, own)
            if assigned and all(n.values()):
                want, x = want + 1, got[c, "+".join(own)]
                assert [tuple(m) for m in x.made] == assigned and (x.filled, x.requested, x.complete) == (len(assigned), len(lines), len(assigned) == len(lines))
                assert x.total == math.floor(sum((m[2] for m in assigned), 0.0) * 100 + 0.5) / 100
                assert [(s.store, -s.minus_n) for s in x.stops] == sorted(n.items(), key=lambda s: (-s[1], s[0])) and all(s.first == next(m[0] for m in assigned if m[1] == s.store) for s in x.stops)
    assert want == len(got)
    shown = plans.recommend(spark.createDataFrame(rows, "cart long, ord int, d double, b double, c double"), names)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in shown and "aggregate(" not in shown


def test_receipt_lines(spark):
    lines = "MILK 2% 4L\n6,47\nGREEK YOGURT\nBANANAS\n1.54 D\n2 @ 3.00 JUICE   6.00\nBAG FEE 0.05\n2024/01/01\n123456789\nmilk 2% 4l 9.99\nHST 0.84\n3 x BUNS\n"
    got = receipts.parse_lines(spark.createDataFrame([(1, lines), (2, None), (3, "")], "receipt_id int, text string")).collect()
    assert [(r.name, r.qty, r.price) for r in got] == [("MILK 2% 4L", None, 6.47), ("BANANAS", None, 1.54), ("3.00 JUICE", 2.0, 6.0), ("BUNS", 3.0, None)]
    assert one(spark, receipts.staple_id(lit("Green Beans 2.5 kg"))) == "receipt_green_beans" and one(spark, receipts.infer_category(lit("Cream Cheese"))) == "dairy"


def test_receipt_matches(spark):
    lines = spark.createDataFrame([("milk",), ("MILK 2L",), ("green beans fancy",), ("nothing",), (None,)], "name string")
    items = spark.createDataFrame([("milk_2pct", "Milk 2%"), ("beans", "Beans green fancy"), ("almond", "Almond milk")], "id string, label string")
    got = {r.name: (r.id, r.score) for r in receipts.match_lines(lines, items).collect()}
    assert got == {"milk": ("milk_2pct", 80), "MILK 2L": ("milk_2pct", 80), "green beans fancy": ("beans", 20)}


def test_tag_prices(spark):
    shop = '{"products":[{"id":"7","title":"Oil 2 L","vendor":" ","tags":["a","INSTOREPRICE:16.59","MARKUP:1.1"],"variants":[{"sku":"0083002800906","available":true,"price":"18.43"}]},{"id":"8","title":"Jam","tags":null,"variants":[{"price":"3"}]}]}'
    got = payloads.tagged_offers(spark.createDataFrame([(shop,), (None,), ("{",)], "payload string")).collect()
    assert [(r.product_id, r.price, r.markup, r.upc, r.brand, r.availability, r.unit_price) for r in got] == [("7", 16.59, 1.1, "0083002800906", None, "in_stock", 8.3)]


def test_merging_upserts(spark):
    base = spark.createDataFrame([("a", 1.0, "x", 1), ("b", 2.0, "y", 5)], "item string, price double, note string, ts int")
    new = spark.createDataFrame([("a", None, "z", 2), ("b", 8.0, None, 4), ("c", 7.0, None, None)], "item string, price double, note string, ts int")
    got = sorted(tuple(r) for r in payloads.merge_upsert(base, new, ["item"], "ts").collect())
    assert got == [("a", 1.0, "z", 2), ("b", 2.0, "y", 5), ("c", 7.0, None, None)]


OFFER = "item string, ord int, product_id string, url string, name string, price double, kg double, availability string, reason string, alternate_reason string, need double, cover double"
ITEM = "item string, cheapest boolean, skip_lock boolean, alternate boolean, use_if_cheaper boolean, keep boolean"
LINK = "item string, sku string, verified boolean, decision string, kind string, skipped boolean"


def resolved(spark, offers, item=("a", False, False, False, None, None), links=()):
    made = [("a", n, *(o.get(c) for c in ("id", "url", "name", "price", "kg", "stock", "reason", "second", "need", "cover"))) for n, o in enumerate(offers)]
    r = resolve.resolve(spark.createDataFrame(made, OFFER), spark.createDataFrame([item], ITEM), spark.createDataFrame(list(links), LINK)).collect()
    assert len(r) == 1
    return r[0].product_id, r[0].reason, r[0].detail


def test_resolution(spark):
    one_, two, box = {"id": "100010", "price": 3.0, "name": "x"}, {"id": "100013", "price": 2.0, "name": "y"}, {"id": "9", "price": 1.0, "name": "y 5x1kg"}
    lock = [("a", "100014", True, None, None, None)]
    assert resolved(spark, [one_, two]) == ("100010", "catalog", None)
    assert resolved(spark, [one_, two], links=lock) == ("100013", "mapped_sku_alias", "100014")
    assert resolved(spark, [one_, two], links=[("a", "100014", True, "needs_review", None, None)])[1] == "catalog"
    assert resolved(spark, [one_, two | {"stock": "out_of_stock"}], links=lock)[0] == "100010"
    cheap = ("a", True, True, False, None, None)
    assert resolved(spark, [one_, two, box], cheap, [("a", "100010", True, None, None, None)]) == ("100013", "filtered_alternate", None)  # a case only where nothing else is
    assert resolved(spark, [one_ | {"need": 4.0}, two | {"need": 5.0}], cheap) == ("100010", "catalog", "need")
    assert resolved(spark, [one_ | {"cover": 9.0}, two | {"cover": 8.0}]) == ("100013", "filtered_alternate", "cover")
    named = ("a", False, False, True, None, None)
    apart = [one_ | {"second": "no"}, two | {"reason": "no"}]
    assert resolved(spark, apart, named)[2] == "alternate_cheaper" and resolved(spark, apart, (*named[:4], False, None)) == ("100010", "catalog", None)
    assert resolved(spark, [one_ | {"reason": "no"}, two | {"reason": "no", "second": None}], named)[2] == "alternate_fallback"
    assert resolved(spark, [one_ | {"reason": "banned"}]) == (None, "rejected_filter", "banned")
    assert resolved(spark, [one_ | {"stock": "out_of_stock"}]) == (None, "no_offer", "not_on_shelf")
    assert resolved(spark, []) == (None, "no_offer", None)


def test_verdicts_from_pasted_texts(spark):
    fenced = '```json\n{"verdicts":[{"stapleId":"milk","store":"mvr","verdict":true,"price":"3.5"},{"id":"egg","store":"walmart","verdict":"ні","productId":" 7 "},{"id":"x","store":"q","verdict":"yes"}]}\n```'
    texts = spark.createDataFrame([(fenced,), ('{"k":{"stapleId":"oil","store":"nofrills","verdict":"yes"},"kind":"x"}',), (None,), ("{",), ("[]",)], "payload string")
    found = verdicts.parse_verdicts(texts)
    assert sorted((r.item, r.verdict, r.empty, r.product_id, r.price) for r in found.collect()) == [("egg", "no", False, "7", None), ("milk", "yes", True, "", 3.5), ("oil", "yes", True, "", None)]
    assert tuple(verdicts.summary(found).first()) == (2, 1, 2, 0, 3)
    cells = spark.createDataFrame([("egg", "walmart", "7"), ("egg", "mvr", None), ("milk", "mvr", None), ("milk", "walmart", "9")], "item string, store string, product_id string")
    got = {r.item: (r.rated, r.total, r.no, r.has_no) for r in verdicts.progress(verdicts.applied(cells, found)).collect()}
    assert got == {"egg": (1, 2, 1, True), "milk": (1, 2, 0, False)}


@pytest.mark.parametrize("raw,want", [('["mvr","walmart","mvr"]', ["mvr", "walmart"]), ("nofrills, q", ["nofrills"]), (None, verdicts.STORES), ("[", verdicts.STORES)])
def test_shown_stores(spark, raw, want):
    assert one(spark, verdicts.parse_stores(F.lit(raw).cast("string"))) == want
    costs = {"walmart": F.lit(3.0), "mvr": F.lit(2.0), "nofrills": F.lit(2.004)}
    r = one(spark, verdicts.cheaper_among(costs, F.array(F.lit("walmart"), F.lit("mvr"), F.lit("nofrills"))))
    assert (r.cheaper, r.delta) == ("tie", 0.0)
    assert one(spark, verdicts.toggle_store(F.array(F.lit("mvr")), F.lit("mvr"))) == ["mvr"]


def test_pairs_without_a_common_group_have_no_conflict_and_pairs_are_dealt(spark):
    words = sorted({w for group, require in identity.CONFLICTS for w in group + require} | {"coffee", "milk"})
    rows = [(a, b) for a in words for b in words]
    some = spark.createDataFrame([([a, "coffee", "oil"], [b, "coffee", "oil"]) for a, b in rows] + [([a, "milk"], [b, "egg"]) for a, b in rows], "a array<string>, b array<string>")
    found = some.select((identity.conflict_groups(F.col("a")).bitwiseAND(identity.conflict_groups(F.col("b"))) != 0).alias("open"), identity.conflict(F.col("a"), F.col("b")).alias("clash")).collect()
    assert all(r.open for r in found if r.clash) and any(r.clash for r in found) and not all(r.open for r in found)
    records = spark.createDataFrame([(i, "n", i % 3) for i in range(9)], "id int, name string, size int")
    assert identity.candidate_pairs(records, "id", [["name", "size"]]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
