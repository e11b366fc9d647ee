"""Price refresh as a stream, against the same rules in a loop."""

import random
import types

import pytest

from larder.streaming import refresh


def attempts(n, seed=3):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        store = r.choice(["a", "a", "a", "b", None])
        outcome = r.choices(["offer", "miss", "blocked", "error", None], [12, 3, 1, 1, 1])[0]
        out.append((
            f"run{seq * 4 // n}", store, r.choice([1, 1, 2, 3]), seq, r.choice(["s", "s", "s", "", None]), outcome, r.choice([1.0, 1.5, 2.0, 9.0, 0.0, None]),
            r.choice([None, None, "form"]), r.choice([True, False, None]), f"m{seq % 5}" if outcome in ("blocked", "error") else None,
        ))
    return out


def loop(rows, clearing):
    blocked, known, out = {}, {}, []
    names = [x.split()[0] for x in refresh.ATTEMPT.split(", ")]
    for row in sorted(rows, key=lambda x: x[3]):
        x = types.SimpleNamespace(**dict(zip(names, row)))
        x.blocked_by = blocked.get((x.run, x.store))
        status, reason, previous = refresh.decided(x, known.get((x.store, x.item)))
        if x.outcome == "blocked" and x.sku is not None:
            blocked.setdefault((x.run, x.store), x.message)
        if status == "updated":
            known[x.store, x.item] = x.price
        elif reason == "not_found" and x.store in clearing:
            known[x.store, x.item] = None
        out.append((x.run, x.store, x.item, x.seq, status, reason, previous, known.get((x.store, x.item))))
    return out


def run(spark, folder, parts, name, clearing=("a",)):
    for part in parts:
        spark.createDataFrame(part, refresh.ATTEMPT).write.mode("append").parquet(f"{folder}/in-{name}")
        query = refresh.land_refreshed(spark, f"{folder}/in-{name}", f"{folder}/out-{name}", f"{folder}/check-{name}", clearing)
        query.awaitTermination()
        assert query.exception() is None
    return sorted((tuple(r)[:8] for r in spark.read.parquet(f"{folder}/out-{name}").collect()), key=lambda x: x[3])


def test_state_goes_on_from_batch_to_batch(spark, tmp_path):
    rows = attempts(160)
    got = run(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], "x")
    assert got == loop(rows, {"a"})
    assert {x[4] for x in got} == {"updated", "failed", "skipped"} and {"price_jump", "not_found", "rejected", "form", "no_sku"} <= {x[5] for x in got}


def test_a_replayed_batch_gives_the_same_rows(spark, tmp_path):
    rows = attempts(60, 9)
    once = run(spark, tmp_path, [rows[:30], rows[30:]], "x")
    for commit in tmp_path.glob("check-x/commits/1"):  # as if the second batch had failed after its output
        commit.unlink()
    for commit in tmp_path.glob("check-x/commits/.1.crc"):
        commit.unlink()
    refresh.land_refreshed(spark, f"{tmp_path}/in-x", f"{tmp_path}/out-x", f"{tmp_path}/check-x", ("a",)).awaitTermination()
    again = sorted((tuple(r)[:8] for r in spark.read.parquet(f"{tmp_path}/out-x").collect()), key=lambda x: x[3])
    assert again == once


@pytest.mark.parametrize("before,now,too_big", [(None, 5.0, False), (1.0, 4.0, True), (1.0, 3.99, False), (4.0, 1.0, True), (0.0, 9.0, False)])
def test_jumps(spark, before, now, too_big):
    from pyspark.sql import functions as F

    from larder.functions.units import price_jump_too_big

    assert refresh.jumps(before, now) == too_big
    column = price_jump_too_big(F.lit(before).cast("double"), F.lit(now))
    assert spark.range(1).select(column.alias("x")).first().x == too_big


def test_states_are_tables_with_one_row_a_key(spark, tmp_path):
    """Thousands of keys, an item in two batches, null keys: both states hold one value a key and stay where the next batch reads them."""
    rows = [(f"run{i % 7}", ["a", "b", None][i % 3], i % 2500 or None, i, "s", "blocked" if i % 1999 == 5 else "offer", 1.0 + i % 5, None, False, f"m{i}") for i in range(6000)]
    got = run(spark, tmp_path, [rows[:3500], rows[3500:]], "x")
    assert got == loop(rows, {"a"})
    last = {(x[1], x[2]): x[7] for x in got if x[7] is not None}
    known = spark.read.schema(refresh.KNOWN).parquet(f"{tmp_path}/check-x/known/1").collect()
    assert len(known) == len(last) and {(r.store, r.item): r.price for r in known} == last
    first = {}
    for x in rows:
        if x[5] == "blocked":
            first.setdefault((x[0], x[1]), (x[3], x[9]))
    assert {(r.run, r.store): (r.seq, r.message) for r in spark.read.schema(refresh.BLOCKED).parquet(f"{tmp_path}/check-x/blocked/1").collect()} == first
