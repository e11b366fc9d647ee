"""Money and comparison scalars. A missing price is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two prices closer than this are a tie; fixed value.
TIE = 0.005


def r2(x: Column) -> Column:
    """Two decimals, half towards plus infinity on the binary double."""
    return F.floor(x * 100 + 0.5) / 100


def present(x: Column) -> Column:
    """Null, zero and NaN count as absent."""
    return x.isNotNull() & (x != 0) & ~F.isnan(x)


def similar(a: Column, b: Column, tolerance: float = 0.2) -> Column:
    """Whether two amounts differ by at most `tolerance` of the smaller one."""
    return F.abs(a - b) / F.least(a, b) <= tolerance


def packs_needed(need: Column, pack: Column) -> Column:
    """Whole packs that cover a need, one at least."""
    return F.greatest(F.ceil(need / pack - 1e-9), F.lit(1)).cast("long")


def prices_agree(a: Column, b: Column, tolerance: float = 0.15) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) / F.least(a, b) <= tolerance), F.lit(False))
