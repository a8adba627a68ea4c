"""Queries over boxes and layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import geometry, layout
from quire.plans.records import _LINES, _lines
from quire.sources.tables import spread, table


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).filter(F.size("box") == 4).select("id", "line_id", "ord", "box")


def crop_geometry(spark: SparkSession, folder: str) -> DataFrame:
    crop = geometry.crop_box(F.col("box"), F.lit(512), F.lit(768))
    return _boxes(spark, folder).select("line_id", F.array_join(crop.cast("array<string>"), ",").alias("crop"), geometry.valid_crop(F.col("box"), F.lit(512), F.lit(768)).alias("valid"))


def interval_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Blank strips between the lines of each page."""
    spans = F.collect_list(F.struct(F.get("box", F.lit(1)).alias("a"), F.get("box", F.lit(3)).alias("b")))
    rows = _boxes(spark, folder).groupBy("id").agg(geometry.gaps(spans).alias("g"))
    return rows.select("id", F.explode("g").alias("g")).select("id", F.col("g.a").cast("bigint").alias("top"), F.col("g.b").cast("bigint").alias("bottom"))


def ink_bands(spark: SparkSession, folder: str) -> DataFrame:
    signs = F.transform("embedding", lambda x: x > 0)
    rows = table(spark, folder, "embeddings").select("vec_id", F.explode(geometry.bands(signs)).alias("b"))
    return rows.select("vec_id", F.col("b.a").alias("first"), F.col("b.b").alias("past"))


def box_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Line boxes of each page, cut into word-like fragments and merged again."""
    b = [F.get("box", F.lit(i)).cast("double") for i in range(4)]
    third = (b[2] - b[0]) / 3
    parts = F.explode(F.transform(F.array(*[F.lit(float(i)) for i in range(3)]), lambda k: F.array(b[0] + k * third, b[1], b[0] + (k + 1) * third - 2, b[3])))
    pages = _boxes(spark, folder).select("id", "ord", parts.alias("part")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    merged = pages.select("id", F.explode(geometry.merged_boxes(F.transform("p", lambda x: x["part"]))).alias("m"))
    return merged.groupBy("id").agg(F.count(F.lit(1)).alias("boxes"), F.sum("m.parts").alias("parts"), F.min(F.col("m.box")[0]).alias("left"), F.max(F.col("m.box")[2]).alias("right"))


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Places and columns that the boxes of each page get from their geometry alone."""
    pages = _boxes(spark, folder).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_id", F.col("box").cast("array<double>").alias("box")))).alias("l"))
    found = geometry.ordered_boxes(F.transform("l", lambda x: x["box"]))
    rows = pages.select("id", "l", F.posexplode(found).alias("place", "o"))
    return rows.select("id", F.get("l", F.col("o.position"))["line_id"].alias("line_id"), "place", F.col("o.column_no").alias("column_no"))


def region_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of texts, one row of a page a character, ink where it isn't blank."""
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "crop_start", "crop_end")]))
    cut = geometry.by_page(lambda text: [dict(zip(("start", "end", "crop_start", "crop_end"), t)) for t in geometry.tile(len(text), [0.0 if c.isspace() else 1.0 for c in text])] if text else [], kind)
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(cut(F.col("text"))).alias("region", "t"))
    return rows.select("doc_id", "region", "t.*")


def fit_line(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).filter((F.size("box") == 4) & F.col("text").isNotNull())
    b = [F.get("box", F.lit(i)).cast("double") for i in range(4)]
    found = layout.fit_size(F.length("text") * 0.6, b[2] - b[0], b[3] - b[1])
    return lines.select("line_id", F.round(found["size"], 6).alias("size"), F.round(found["scale"], 6).alias("scale"))


def wrap_text(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import types as T

    font = layout.Font({})
    wrapped = geometry.by_page(lambda text: layout.wrap(font, text or "", 464.0, 10.0), T.ArrayType(T.StringType()))
    rows = table(spark, folder, "labels").select("id", "text").distinct().select("id", F.posexplode(wrapped(F.col("text"))).alias("row", "line"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("line")).alias("longest"))


def merged_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What merging must keep: all fragments, and the sides of the page's text."""
    return box_merge(spark, folder).select("id", "parts", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


def reading_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Each box of a page has one place in its reading order, from 0 on."""
    return reading_order(spark, folder).groupBy("id").agg(F.count_distinct("line_id").alias("lines"), F.count_distinct("place").alias("places"), (F.max("place") + 1).cast("bigint").alias("last"))


def tile_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Regions cover every row once, and each crop holds its region."""
    r = region_tiling(spark, folder)
    inside = (F.col("crop_start") <= F.col("start")) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("crop_end"))
    return r.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("rows"), F.min("start").alias("first"), F.max("end").cast("bigint").alias("last"), F.bool_and(inside).alias("inside"))


def wrap_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapping keeps all characters but blanks, and no row is wider than the page."""
    from pyspark.sql import types as T

    font = layout.Font({})
    wrapped = geometry.by_page(lambda text: layout.wrap(font, text or "", 464.0, 10.0), T.ArrayType(T.StringType()))
    rows = table(spark, folder, "labels").select("id", "text").distinct().select("id", "text", F.explode(wrapped(F.col("text"))).alias("line"))
    return rows.groupBy("id", "text").agg(F.sum(F.length(F.replace("line", F.lit(" "), F.lit("")))).alias("signs"), (F.max(F.length("line")) <= 77).alias("fits")).select("id", F.sha2("text", 256).alias("text"), "signs", "fits")


def placed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each page are placed where they are, moved, or fit nowhere."""
    lines = _lines(spark, folder).filter((F.size("box") == 4) & F.col("text").isNotNull()).select("id", "ord", "line_id", "text", F.col("box").cast("array<double>").alias("rect"))
    pages = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "line_id", "rect", "text"))).alias("l"))
    rows = pages.select("id", F.explode(F.arrays_zip("l", layout.placed(F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["rect"].alias("rect"))), (512.0, 768.0)).alias("p"))).alias("z"))
    own = F.col("z.p.rect") == F.col("z.l.rect")
    fits = F.col("z.p.size").isNotNull()
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(fits & own).alias("own"), F.count_if(fits & ~own).alias("moved"), F.count_if(~fits).alias("nowhere"))


def placed_own(spark: SparkSession, folder: str) -> DataFrame:
    return placed_lines(spark, folder).select("id", "lines", "own")


SQL = {
    "crop_geometry": f"""WITH {_LINES} SELECT line_id, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 || ',' || y0 || ',' || x1 || ',' || y1 END AS crop, coalesce(box[1] >= 0 AND box[2] >= 0 AND box[1] < box[3] AND box[2] < box[4] AND box[3] <= 512 AND box[4] <= 768, false) AS valid
        FROM (SELECT line_id, box, greatest(box[1] - 1, 0) AS x0, greatest(box[2] - 1, 0) AS y0, least(box[3] + 1, 512) AS x1, least(box[4] + 1, 768) AS y1 FROM lines WHERE len(box) = 4)""",
    "interval_gaps": f"""WITH {_LINES}, i AS (SELECT id, box[2] AS a, max(box[4]) OVER (PARTITION BY id ORDER BY box[2], box[4] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines WHERE len(box) = 4)
        SELECT id, before::BIGINT AS top, a::BIGINT AS bottom FROM i WHERE a > before""",
    "merged_bounds": f"WITH {_LINES} SELECT id, (3 * count(*))::BIGINT AS parts, min(box[1])::DOUBLE AS left, max(round(box[1] + 3 * ((box[3] - box[1])::DOUBLE / 3) - 2, 6)) AS right FROM lines WHERE len(box) = 4 GROUP BY id",
    "reading_cover": f"WITH {_LINES} SELECT id, count(DISTINCT line_id) AS lines, count(*) AS places, count(*) AS last FROM lines WHERE len(box) = 4 GROUP BY id",
    "tile_cover": "SELECT doc_id, length(text) AS rows, 0 AS first, length(text) AS last, true AS inside FROM documents WHERE text <> ''",
    "wrap_cover": "SELECT DISTINCT id, sha256(text) AS text, length(replace(text, ' ', '')) AS signs, true AS fits FROM labels WHERE text <> ''",
    "placed_own": f"""WITH {_LINES}, m AS (SELECT id, length(text) * 0.6::DOUBLE AS adv, (box[3] - box[1])::DOUBLE AS w, (box[4] - box[2])::DOUBLE AS h FROM lines WHERE len(box) = 4 AND text IS NOT NULL),
        s AS (SELECT *, least(14.0::DOUBLE, h) AS tall FROM m), z AS (SELECT *, CASE WHEN adv * tall > w THEN greatest(6.0::DOUBLE, w / adv) ELSE tall END AS size FROM s)
        SELECT id, count(*) AS lines, count(*) FILTER (WHERE tall >= 6 AND (adv = 0 OR least(1.0::DOUBLE, w / (adv * size)) >= 0.8)) AS own FROM z GROUP BY id""",
    "ink_bands": """WITH v AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding) > 0 AS s FROM embeddings),
        g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM v WHERE s)
        SELECT vec_id, min(i) AS first, (max(i) + 1)::INT AS past FROM g GROUP BY vec_id, k""",
    "fit_line": f"""WITH {_LINES}, m AS (SELECT line_id, length(text) * 0.6::DOUBLE AS adv, (box[3] - box[1])::DOUBLE AS w, (box[4] - box[2])::DOUBLE AS h FROM lines WHERE len(box) = 4 AND text IS NOT NULL),
        s AS (SELECT *, least(14.0::DOUBLE, h) AS tall FROM m), z AS (SELECT *, CASE WHEN adv * tall > w THEN greatest(6.0::DOUBLE, w / adv) ELSE tall END AS size FROM s),
        c AS (SELECT *, CASE WHEN adv > 0 THEN least(1.0::DOUBLE, w / (adv * size)) ELSE 1.0 END AS scale FROM z)
        SELECT line_id, CASE WHEN tall >= 6 AND scale >= 0.8 THEN round(size, 6) END AS size, CASE WHEN tall >= 6 AND scale >= 0.8 THEN round(scale, 6) END AS scale FROM c""",
}

ALL = (crop_geometry, interval_gaps, ink_bands, box_merge, merged_bounds, reading_order, reading_cover, region_tiling, tile_cover, fit_line, wrap_text, wrap_cover, placed_lines, placed_own)
