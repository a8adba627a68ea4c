"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import assets, decoding, layouts, pages, records, selecting, words

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f for f in (pages.p2_found, pages.p2_pages, pages.p2_rows, pages.p2_lines, pages.p2_sources, pages.p2_crops, pages.p2_counts, assets.p5_found, assets.p5_packs, assets.p5_members, assets.p5_totals)
}
SQL: dict[str, str] = assets.SQL | pages.SQL
for module in (records, words, decoding, selecting, layouts):
    QUERIES |= {f.__name__: f for f in module.ALL}
    SQL |= module.SQL
