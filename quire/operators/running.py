"""Running totals over a whole table without a one-task window.

Rows are put into bins by a value that depends on the row alone, so every retry of a
task sees the same bins. Bin totals (one row a bin and group) are summed in a window,
and each bin is then summed on its own. A bin holds a bounded share of the rows because
its number comes from a hash or a near-uniform rank, whatever the group sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bin(order: Column, bins: int) -> Column:
    """Bin of a 64-bit hash such that bins ascend as the hash does."""
    top = F.shiftright(order, 40).cast("bigint") + F.lit(1 << 23)
    return (top * F.lit(bins) / F.lit(1 << 24)).cast("int")


def running_total(
    df: DataFrame, value: str, bin_col: str, order: list[str], out: str, group: list[str] | None = None
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group up to and with this one,
    in the order of (bin_col, *order). Nulls in `value` count as 0. `order` must break
    ties; rows equal in all of it get an arbitrary order among themselves."""
    return running_totals(df, {out: value}, bin_col, order, group)


def running_totals(df: DataFrame, values: dict[str, str], bin_col: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """The same for several values at once: name of the total -> value."""
    group = group or []
    amount = {out: F.coalesce(F.col(v), F.lit(0)) for out, v in values.items()}
    totals = df.groupBy(*group, bin_col).agg(*[F.sum(a).alias(f"_of_{out}") for out, a in amount.items()])
    before = Window.partitionBy(*group).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, bin_col, *[F.coalesce(F.sum(f"_of_{out}").over(before), F.lit(0)).alias(f"_at_{out}") for out in amount])
    inside = Window.partitionBy(*group, bin_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, bin_col]]
    joined = df.alias("a").join(starts.alias("b"), keys, "left").select("a.*", *[f"b._at_{out}" for out in amount])
    return joined.withColumns({out: F.col(f"_at_{out}") + F.sum(a).over(inside) for out, a in amount.items()}).drop(*[f"_at_{out}" for out in amount])
