"""Leak-free splits of pages and the bookkeeping around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.running import running_totals

#: Page numbers that share a bin, in which pages are counted by one task.
PAGES_A_BIN = 1_024


def final_block(pages: DataFrame, group: str, page: str, fraction: float = 0.2) -> DataFrame:
    """(group, page, role): of each group's n distinct pages (whole numbers) the last
    min(n - 1, max(1, ceil(n * fraction))) are for validation, the others for training.
    Nulls are left out. Pages are counted from behind in bins, so that a group that holds
    very many of them is shared out."""
    distinct = pages.select(group, page).filter(F.col(group).isNotNull() & F.col(page).isNotNull()).distinct()
    down = -F.col(page).cast("bigint")
    binned = distinct.withColumns({"_one": F.lit(1), "_down": down, "_bin": F.floor(down / PAGES_A_BIN)})
    ranked = running_totals(binned, {"_rank": "_one"}, "_bin", ["_down"], [group])
    sizes = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    held = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.ceil(F.col("_n").cast("double") * F.lit(float(fraction)))))
    return ranked.join(sizes, group).select(group, page, F.when(F.col("_rank") <= held, "validation").otherwise("train").alias("role"))
