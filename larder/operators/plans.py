"""Purchase plans: which one, two or three stores to visit for a cart."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions.money import TIE, r2

#: What a cheaper split has to save, what one extra item's stop has to save, how much more a second single store may cost; fixed values.
LEAST_SAVING, LEAST_SINGLE, NEAR_SUM, NEAR_SHARE = 0.5, 2.0, 8.0, 1.08
SHOWN = 3
#: Carts times sets of stores that are in memory at once.
CART_PLANS = 100_000


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b as Spark orders doubles: NaN is above all."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _cents(x: np.ndarray) -> np.ndarray:
    """money.r2 in numpy; the floor is a long, so NaN is 0."""
    return np.nan_to_num(np.clip(np.floor(x * 100 + 0.5), -(2.0**63), 2.0**63)) / 100


def _chosen(cost: np.ndarray, has: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(store, cost) of each row: the stores are asked in order, and a later one wins if it is cheaper or as cheap with more lines (n)."""
    rows = np.arange(len(cost))
    store = has.argmax(axis=1)
    best = cost[rows, store]
    for s in range(1, cost.shape[1]):
        asked = has[:, s] & (s > store)
        less = asked & _below(cost[:, s], best - TIE)
        near = asked & ~less & (np.abs(cost[:, s] - best) < TIE) & (n[:, s] > n[rows, store]) if n is not None else False
        store, best = np.where(less | near, s, store), np.where(less, cost[:, s], best)  # a tie keeps the price it was compared with
    return store, best


def _assigned(cost: np.ndarray, has: np.ndarray, cart: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, store, cost): lines at their cheapest store of a set; cart: of each line, ascending; start: each cart's first line.

    Lines that one store alone has come first; each other line goes to its cheapest store, one within half a cent to the
    store that has more lines so far, then to the earlier store. Only such ties depend on the order of the lines: they are
    settled in rounds, the first tie of all carts, then the second.
    """
    number = has.sum(axis=1)
    only, shared = np.flatnonzero(number == 1), np.flatnonzero(number > 1)
    store, best = _chosen(cost, has)
    tied = np.zeros(len(cost), bool)
    for i, j in combinations(range(cost.shape[1]), 2):
        tied |= has[:, i] & has[:, j] & (np.abs(cost[:, i] - cost[:, j]) < 2 * TIE)  # wider than a tie, as a choice by rounds is always right
    tie = shared[tied[shared]]
    if len(tie):
        made = np.zeros((len(start), cost.shape[1]), np.int64)  # lines of each cart and store: first those of one store, then ties as they are settled
        np.add.at(made, (cart[only], store[only]), 1)
        sure = np.zeros((len(cost) + 1, cost.shape[1]), np.int64)  # lines before each line that need no tie
        plain = shared[~tied[shared]]
        sure[plain + 1, store[plain]] = 1
        sure = np.cumsum(sure, axis=0)
        before = sure[tie] - sure[start[cart[tie]]]
        first = np.flatnonzero(np.diff(cart[tie], prepend=-1))
        place = np.arange(len(tie)) - np.repeat(first, np.diff(np.append(first, len(tie))))
        by = np.argsort(place, kind="stable")
        for own in np.split(by, np.cumsum(np.bincount(place))[:-1]):
            line = tie[own]
            store[line], best[line] = _chosen(cost[line], has[line], made[cart[line]] + before[own])
            made[cart[line], store[line]] += 1
    line = np.concatenate([only, shared])
    return line, store[line], best[line]


def _listed(mask: np.ndarray, values: pa.Array) -> pa.Array:
    """values, those of the places where a mask holds, as one list for each row of the mask."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(mask.reshape(len(mask), -1).sum(axis=1))), pa.int32()), values)


def _planned(batches: Iterator[pa.RecordBatch], stores: list[str], sets: list[tuple[str, ...]], more: list[tuple[str, ...]], whole: bool) -> Iterator[pa.RecordBatch]:
    """Batches of carts with their plans behind: of the sets, and of more sets for carts where none of the first is complete; whole: with their lines."""
    every, most = sets + more, max(map(len, sets + more), default=1)
    step = max(1, CART_PLANS // max(1, len(every)))
    for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
        lists = batch.column("lines")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        lines = lists.flatten()
        ords, costs = lines.field("ord"), lines.field("costs")
        cost = np.column_stack([np.zeros((len(lines), 0)), *[costs.field(s).to_numpy(zero_copy_only=False) for s in stores]])
        valid = np.column_stack([np.zeros((len(lines), 0), bool), *[costs.field(s).is_valid().to_numpy(zero_copy_only=False) for s in stores]])
        has = valid & ((cost > 0) | np.isnan(cost))
        cart, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        total, filled, keep = np.zeros((len(sizes), len(every))), np.zeros((len(sizes), len(every)), np.int32), np.zeros((len(sizes), len(every)), bool)
        stops = np.zeros((len(sizes), len(every), most), [("n", np.int32), ("store", np.int32), ("first", np.int64), ("sum", np.float64)])
        made = []
        need = np.ones(len(sizes), bool)
        for j, names in enumerate(every):
            if j == len(sets):
                need = ~(keep & (filled == sizes[:, None])).any(axis=1)
            own = np.flatnonzero(need[cart])
            at, k = [stores.index(s) for s in names], len(names)
            begin = np.cumsum(np.where(need, sizes, 0)) - np.where(need, sizes, 0)
            line, store, paid = _assigned(cost[np.ix_(own, at)], has[np.ix_(own, at)], cart[own], begin)
            line = own[line]
            of = cart[line]
            key = of * k + store
            n = np.bincount(key, minlength=len(sizes) * k).reshape(-1, k).astype(np.int32)
            first = np.zeros(len(sizes) * k, np.int64)
            first[key[::-1]] = line[::-1]
            found = np.zeros((len(sizes), k), stops.dtype)
            found["n"], found["store"], found["first"] = n, at, first.reshape(-1, k)
            found["sum"] = _cents(np.bincount(key, paid, len(sizes) * k)).reshape(-1, k)  # bincount adds in the order of the lines
            found = found[:, np.argsort(np.array(names, object), kind="stable")]
            stops[:, j, :k] = np.take_along_axis(found, np.argsort(-found["n"], axis=1, kind="stable"), axis=1)
            total[:, j], filled[:, j] = _cents(np.bincount(of, paid, len(sizes))), np.bincount(of, minlength=len(sizes))
            keep[:, j] = need & (n > 0).all(axis=1)
            if whole:
                made.append((of, np.full(len(of), j), np.array(at)[store], line, paid))
        k = np.array([len(c) for c in every], np.int32)
        plan = np.broadcast_to(np.arange(len(every)), keep.shape)[keep]
        stop = stops[keep][np.arange(most) < k[plan, None]]
        named = lambda x: pa.array(stores, pa.string()).take(pa.array(x))
        fields = {
            "plan": pa.array(["+".join(c) for c in every], pa.string()).take(pa.array(plan)), "stores": pa.array(list(map(list, every)), pa.list_(pa.string())).take(pa.array(plan)),
            "n_stops": pa.array(k[plan]), "total": pa.array(total[keep]), "complete": pa.array((filled == sizes[:, None])[keep]), "filled": pa.array(filled[keep]),
            "requested": pa.array(np.broadcast_to(sizes[:, None], keep.shape)[keep].astype(np.int32)),
            "stops": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k[plan])), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(-stop["n"]), named(stop["store"]), ords.take(pa.array(stop["first"])), pa.array(stop["sum"])], names=["minus_n", "store", "first", "subtotal"])),
        }
        if whole:
            of, j, store, line, paid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*made) if made else [()] * 5))
            by = np.flatnonzero(keep[of, j])
            by = by[np.lexsort((j[by], of[by]))]
            fields["made"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(filled[keep])), pa.int32()), pa.StructArray.from_arrays(
                [ords.take(pa.array(line[by])), named(store[by]), pa.array(paid[by].astype(float))], names=["ord", "store", "cost"]))
        yield pa.RecordBatch.from_arrays([*batch.columns, _listed(keep, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))], names=[*batch.schema.names, "plans"])


def _carts(lines: DataFrame, stores: list[str]) -> DataFrame:
    """cart, lines (in order) and requested; the lines of a cart meet in one row, as they do in a shopping list."""
    costs = F.struct(*[F.col(s).cast("double").alias(s) for s in stores])
    carts = lines.groupBy("cart").agg(F.sort_array(F.collect_list(F.struct("ord", costs.alias("costs")))).alias("lines"))
    return carts.withColumn("requested", F.size("lines"))


def _plans(carts: DataFrame, stores: list[str], sets: list[tuple[str, ...]], more: list[tuple[str, ...]], whole: bool = False) -> DataFrame:
    """carts with plans, an array<struct<plan, stores, n_stops, total, complete, filled, requested, stops>> of the sets whose stores all get a line.

    more: sets for the carts where none of the first is complete; whole: with made, the lines in the order in which they were assigned.
    """
    of = carts.schema["lines"].dataType.elementType["ord"].dataType.simpleString()
    made = f", made: array<struct<ord: {of}, store: string, cost: double>>" if whole else ""
    plan = (
        "plan: string, stores: array<string>, n_stops: int, total: double, complete: boolean, filled: int, requested: int, "
        f"stops: array<struct<minus_n: int, store: string, first: {of}, subtotal: double>>{made}"
    )
    schema = StructType([*carts.schema.fields, *StructType.fromDDL(f"plans array<struct<{plan}>>").fields])
    return carts.mapInArrow(lambda it: _planned(it, stores, sets, more, whole), schema)


def cart_plans(lines: DataFrame, stores: list[str], most: int = 3) -> DataFrame:
    """One row per cart and set of up to `most` stores: cart, plan, stores, n_stops, total, complete, filled, requested, stops, made, lines.

    lines: cart, ord, and a column of cost for each store, null or not positive where it has none. A set of which some
    store gets no line is no plan.
    """
    sets = [c for k in range(1, most + 1) for c in combinations(stores, k)]
    return _plans(_carts(lines, stores), stores, sets, [], whole=True).select("cart", "lines", F.explode("plans").alias("p")).select("cart", "p.*", "lines")


def _justified(plan: Column, best: Column, saving: Column, lines: Column, stores: list[str]) -> Column:
    """Whether a plan's further stops are worth it; best: the least (total, plan) of the complete single stores, null if there is none."""
    main = F.get(plan["stops"], F.lit(0))
    fewest = F.element_at(plan["stops"], -1)["minus_n"]
    smallest = F.get(F.filter(plan["stops"], lambda s: s["minus_n"] == fewest), F.lit(0))  # the first of those with the fewest lines
    also = F.exists(lines, lambda x: (x["ord"] == smallest["first"]) & F.coalesce(F.coalesce(*[F.when(main["store"] == s, x["costs"][s]) for s in stores]) > 0, F.lit(False)))
    small = (fewest == -1) & (smallest["store"] != main["store"]) & also & (saving < LEAST_SINGLE)
    return (
        F.when(plan["n_stops"] == 1, True).when(~plan["complete"], best.isNull()).when(best.isNull(), True)
        .otherwise((saving >= LEAST_SAVING) & (plan["n_stops"] <= 2) & ~small)
    )


def recommend(lines: DataFrame, stores: list[str]) -> DataFrame:
    """At most three plans of each cart: cart, place, plan, kind, n_stops, total, filled, requested, saving, recommended.

    Shown are the best complete store, a second one within 8 dollars or 8 %, the best justified split; without a complete plan the
    stores and the split that cover most. A split of two is justified if it saves 50 cents (2 dollars where its smallest stop
    is a single item that the main store has too) or fills what no single store has; three stores are tried only where neither one
    nor two are complete. The plans of a cart are one array; those of all carts of a batch are made at once, in numpy.
    """
    sets = lambda k: list(combinations(stores, k))
    at = lambda a, i: F.get(a, F.lit(i))
    carts = _plans(_carts(lines, stores), stores, sets(1) + sets(2), sets(3))
    best = F.array_min(F.transform(F.filter("plans", lambda p: p["complete"] & (p["n_stops"] == 1)), lambda p: F.struct(p["total"].alias("total"), p["plan"].alias("plan"))))
    carts = carts.withColumn("best", best)

    def told(p: Column) -> Column:
        saving = F.when(F.col("best").isNotNull() & p["complete"] & (p["n_stops"] > 1), r2(F.col("best.total") - p["total"]))
        kind = F.when(p["n_stops"] == 1, "one_store").when(F.coalesce(p["total"] + TIE < F.col("best.total"), F.lit(False)) & p["complete"], "split_cheaper").otherwise("split_fill")
        return F.struct(
            (~p["complete"]).alias("incomplete"), (-p["filled"]).alias("minus_filled"), p["n_stops"].alias("n_stops"), p["total"].alias("total"),
            F.when(p["n_stops"] == 1, F.array_position(F.array(*map(F.lit, stores)), p["plan"])).otherwise(0).alias("place"), p["plan"].alias("plan"), kind.alias("kind"), p["complete"].alias("complete"), p["filled"].alias("filled"), p["requested"].alias("requested"), saving.alias("saving"),
            _justified(p, F.col("best"), saving, F.col("lines"), stores).alias("justified"),
        )

    sorted_plans = F.array_sort(F.filter(F.transform("plans", told), lambda p: F.coalesce(p["justified"], F.lit(False))))
    kinds = {"singles": lambda p: (p["n_stops"] == 1) & p["complete"], "partial": lambda p: (p["n_stops"] == 1) & ~p["complete"], "splits": lambda p: p["n_stops"] > 1}
    grouped = carts.withColumn("p", sorted_plans).withColumns({c: F.filter("p", f) for c, f in kinds.items()})
    singles, partial, splits = map(F.col, kinds)
    first, second = at(singles, 0), at(singles, 1)
    close = (second["total"] <= first["total"] + NEAR_SUM) | (second["total"] <= first["total"] * NEAR_SHARE)
    entire = at(F.filter(splits, lambda p: p["complete"]), 0)
    some = first.isNotNull() | entire.isNotNull()
    shown = F.array(
        first, F.when(close, second), entire, F.when(~some, at(partial, 0)), F.when(~some | entire.isNull(), at(splits, 0)), F.when(~some, at(partial, 1)),
    )
    listed = grouped.withColumn("shown", F.slice(F.array_compact(shown), 1, SHOWN))
    complete = F.filter("shown", lambda p: p["complete"])
    pair = at(F.filter(complete, lambda p: p["n_stops"] == 2), 0)
    worth = (pair["kind"] == "split_cheaper") & (pair["total"] + LEAST_SAVING <= F.col("best.total") + TIE)
    fields = ("incomplete", "minus_filled", "n_stops", "total", "plan")  # by name where all else is equal, not by the order of the stores
    named = F.array_min(F.transform("shown", lambda p: F.struct(*[p[c].alias(c) for c in fields])))
    chosen = F.coalesce(F.when(worth, pair["plan"]), F.col("best.plan"), at(complete, 0)["plan"], named["plan"])
    return listed.select("cart", chosen.alias("chosen"), F.posexplode_outer("shown").alias("place", "q")).where("place is not null").select(
        "cart", "place", "q.plan", "q.kind", "q.n_stops", "q.total", "q.filled", "q.requested", "q.saving", (F.col("q.plan") == F.col("chosen")).alias("recommended")
    )
