"""Like-for-like comparison of two or more stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.money import TIE, present, r2, similar


def cheapest_of(sides: list[tuple[str, Column]]) -> Column:
    """Name of the cheapest side, 'tie' within half a cent, 'incomplete' under two values."""
    values = F.array_compact(F.array(*[v for _, v in sides]))
    least = F.array_min(values)
    near = F.array_compact(F.array(*[F.when(F.abs(v - least) < TIE, F.lit(n)) for n, v in sides]))
    return F.when(F.size(values) < 2, "incomplete").when(F.size(near) > 1, "tie").otherwise(F.get(near, F.lit(0)))


def spread(values: list[Column]) -> Column:
    """First minus second of two; of more, the least minus the next, which is never positive."""
    if len(values) == 2:
        return r2(values[0] - values[1])
    found = F.array_sort(F.array_compact(F.array(*values)))
    return F.when(F.size(found) > 1, r2(F.get(found, F.lit(0)) - F.get(found, F.lit(1))))


def fair_compare(sides: list[tuple[str, Column, Column]]) -> Column:
    """struct<basis, cheaper, delta> of sides (name, shelf price, pack kg).

    Packs that are alike compare by shelf price, others by the price of 100 g; a basis
    counts only if every usable side has it. A side is usable with a price.
    """
    usable = [F.coalesce(p > 0, F.lit(False)) for _, p, _ in sides]
    n = sum((u.cast("int") for u in usable), F.lit(0))
    every = lambda parts: F.forall(F.array(*[~u | F.coalesce(p, F.lit(False)) for u, p in zip(usable, parts)]), lambda x: x)
    kgs = F.filter(F.array(*[F.when(u & present(k), k) for u, (_, _, k) in zip(usable, sides)]), lambda k: k.isNotNull())
    known = every([present(k) for _, _, k in sides])
    alike = known & similar(F.array_max(kgs), F.array_min(kgs))
    per_pack = [(name, F.when(u, p)) for u, (name, p, _) in zip(usable, sides)]
    per_100g = [(name, F.when(u, r2(r2(p / k) / 10))) for u, (name, p, k) in zip(usable, sides)]
    basis = F.when(n < 2, "incomparable").when(alike, "per_pack").when(known, "per_100g").otherwise("incomparable")
    pick = lambda f: F.when(basis == "per_pack", f(per_pack)).when(basis == "per_100g", f(per_100g))
    return F.struct(basis.alias("basis"), pick(cheapest_of).alias("cheaper"), pick(lambda s: spread([v for _, v in s])).alias("delta"))
