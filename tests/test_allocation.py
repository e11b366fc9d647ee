"""Ids given in turn, against a loop."""

import random

import pytest

from larder.operators import receipts


def loop(bases, taken):
    used, out = set(taken), []
    for base in bases:
        name, n = base, 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ids_against_a_loop(spark, seed):
    r = random.Random(seed)
    names = ["x", "x", "x", "x", "x_2", "x_2_2", "x_3", "y", "y", "y", "z_1", "z_02", "hot", "hot", "hot", "hot", "hot", "w_7", "w"]
    bases = [r.choice(names[7:] if seed == 2 else names) for _ in range(200)]
    taken = ["y_3", "y_2", "hot_5", "hot_4", "hot", "hot_90", "x_4", "z_1_2", "z_1_1", "z_1_02", "other_2", "w_7_2", "w_8"]
    rows = [(i, b, 5, "n") for i, b in enumerate(bases)]
    df = spark.createDataFrame(rows, "ord int, base string, place int, turn string").drop("place", "turn").repartition(3)
    got = receipts.allocate(df, spark.createDataFrame([(t,) for t in [*taken, "y_2", None]], "id string"), ["ord"])
    assert {x.ord: x.id for x in got.collect()} == dict(enumerate(loop(bases, taken)))


def test_lines_are_decided(spark):
    lines = spark.createDataFrame(
        [(1, 1, "Cream Cheese 250 g"), (1, 2, "CREAM CHEESE"), (1, 3, "BAG FEE"), (2, 1, "Milk"), (2, 2, "Cream cheese"), (2, 3, None), (2, 4, "Green Beans")], "receipt_id int, line_no int, name string"
    )
    items = spark.createDataFrame([("milk_2pct", "Milk 2%")], "id string, label string")
    got = {(r.receipt_id, r.line_no): r for r in receipts.decide_lines(lines, items, spark.createDataFrame([("receipt_green_beans",), ("receipt_cream_cheese_2",)], "id string")).collect()}
    assert [got[k].status for k in sorted(got)] == ["new", "new", "skip", "existing", "new", "skip", "new"]
    assert [got[k].id for k in sorted(got)] == ["receipt_cream_cheese", "receipt_cream_cheese_3", None, "milk_2pct", "receipt_cream_cheese_4", None, "receipt_green_beans_2"]
    assert (got[1, 1].category, got[1, 1].match_mode, got[1, 1].words, got[2, 4].match_mode) == ("dairy", "exact", ["Cream", "Cheese"], "exact")
