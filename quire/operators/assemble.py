"""Assembly of lines into pages: context, ordered text, status by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precedence of line states; the highest present is the page's.
RANKS = {"ok": 0, "review": 1, "error": 2, "pending": 3}


def context(lines: DataFrame, page: str, order: str, column: str, text: str, radius: int = 2) -> DataFrame:
    """Add `context`: texts of the lines at most `radius` places away in the page's order
    that stand in the same column. The frame is taken over the whole page first, and only
    then other columns and the line itself are dropped."""
    w = Window.partitionBy(page).orderBy(order)
    frame = F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("c"), F.col(text).alias("t"))).over(w.rowsBetween(-radius, radius))
    near = F.filter(frame, lambda x: x["c"].eqNullSafe(F.col(column)) & ~x["o"].eqNullSafe(F.col(order)))
    return lines.withColumn("context", F.transform(near, lambda x: x["t"]))


def ordered_text(lines: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "\n", missing: str | None = None) -> DataFrame:
    """(keys, text): texts in order joined by a separator; nulls are left out, or written
    as `missing`."""
    value = F.col(text) if missing is None else F.coalesce(text, F.lit(missing))
    row = F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], value.alias("_text"))
    ranked = F.array_sort(F.collect_list(row))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ranked, lambda x: x["_text"]), separator).alias("text"))


def status_rollup(lines: DataFrame, keys: list[str], status: str, lift: Column | None = None) -> DataFrame:
    """(keys, status): pending before error before review before ok; unknown states count
    as pending. `lift`, an aggregate, turns ok into review where true."""
    rank = F.lit(RANKS["pending"])
    for name, value in RANKS.items():
        rank = F.when(F.col(status) == name, value).otherwise(rank)
    worst = F.max(rank)
    if lift is not None:
        worst = F.when((worst == 0) & F.coalesce(lift, F.lit(False)), 1).otherwise(worst)
    names = F.array(*[F.lit(n) for n in RANKS])
    return lines.groupBy(*keys).agg(F.get(names, worst).alias("status"))


def block_rollup(blocks: DataFrame, keys: list[str], status: str, expected: str) -> DataFrame:
    """(keys, status): pending while blocks are missing, ok if all are ok, else review."""
    done, fine = F.count(F.when(F.col(status).isNotNull(), 1)), F.bool_and(F.col(status) == "ok")
    state = F.when(done < F.max(expected), "pending").when(fine, "ok").otherwise("review")
    return blocks.groupBy(*keys).agg(state.alias("status"))


def markdown(pages: DataFrame) -> DataFrame:
    """(id, section): a page (id, status, text) as a Markdown section; a page or block that
    wasn't read is shown as such."""
    body = F.coalesce("text", F.lit("[pending block]"))
    return pages.select("id", F.concat(F.lit("## "), F.col("id"), F.lit("\n\nStatus: "), F.coalesce("status", F.lit("pending")), F.lit("\n\n"), body, F.lit("\n")).alias("section"))
