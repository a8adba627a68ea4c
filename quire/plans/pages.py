"""Evidence pages as tables of pages, lines, sources and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import is_blank
from quire.operators.shred import GROUP, content_hash, from_json_forms, record_key, shred
from quire.session import settle
from quire.sources.tables import spread, table

#: Field that holds an element's key where its container is an object.
KEYS = {"lines": "line_id", "sources": "view", "crops": "view"}
#: Columns that say where and when a record was stored rather than what it says.
STORAGE = ["origin", "raw_id", "loaded_at"]


def _grouped(schema: T.StructType) -> T.StructType:
    """The type of a page record with the place of the group that a line may stand in."""
    lines = schema["lines"].dataType.elementType
    return T.StructType([T.StructField("lines", T.ArrayType(T.StructType([*lines, T.StructField(GROUP, T.StringType())]))) if f.name == "lines" else f for f in schema])


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """All page records of `ocr_lines` and `ocr_raw` in one form, with the row they come from
    (origin, raw_id, loaded_at) and the `page_key` that all rows of one record share: its
    origin, id, fingerprint, time of writing and a hash of its content.

    The type of `ocr_lines` is the form; JSON records are fitted to it once and kept, as
    every table reads them. A payload that isn't an object gives a record of nulls, so that
    it stays countable.
    """
    typed = table(spark, folder, "ocr_lines")
    said = T.StructType([f for f in typed.schema if f.name not in STORAGE])
    fields = _grouped(T.StructType([f for f in said if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]))
    raw = spread(table(spark, folder, "ocr_raw")).select("raw_id", "loaded_at", from_json_forms(F.col("payload"), fields, KEYS).alias("r"))
    raw = settle(raw.select("raw_id", "loaded_at", *[F.col(f"r.`{f.name}`") for f in fields]), "fitted")
    typed = typed.withColumn("lines", F.transform("lines", lambda x: x.withField(GROUP, F.lit(None).cast("string"))))
    rows = typed.withColumn("origin", F.lit("ocr_lines")).unionByName(raw.withColumn("origin", F.lit("ocr_raw")), allowMissingColumns=True)
    content = content_hash(rows, [f.name for f in fields if f.name not in ("id", "fingerprint")])
    return rows.withColumn("page_key", record_key(F.col("origin"), F.col("id"), F.col("fingerprint"), F.col("written_at"), content))


def page_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """`pages`, `lines`, `sources` and `crops`, each child with its parents' keys and with the
    `id` of its page and the `line_id` of its line; and `rows`, which names for each source
    row the page it holds. Tables keep repeats of a record: see distinct()."""
    rows = evidence(spark, folder)
    said = rows.drop(*STORAGE, "page_key")
    tables = shred(rows.select("page_key", *said.columns), F.col("page_key"), "pages", "page_key", {"pages": ["id"], "lines": ["line_id"]})
    pages, crops = tables["pages"].drop("page_key_value"), tables["crops"].withColumnsRenamed({"key": "view", "value": "path"})
    return tables | {"pages": pages, "crops": crops, "rows": rows.select("page_key", *STORAGE)}


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_tables(spark, folder)["pages"].distinct()


def p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    return page_tables(spark, folder)["rows"]


def p2_lines(spark: SparkSession, folder: str) -> DataFrame:
    return page_tables(spark, folder)["lines"].distinct()


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    return page_tables(spark, folder)["sources"].distinct()


def p2_crops(spark: SparkSession, folder: str) -> DataFrame:
    return page_tables(spark, folder)["crops"].distinct()


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines, by id, each page of either table has in the table of lines."""
    lines = page_tables(spark, folder)["lines"].filter("line_id is not null")
    return lines.groupBy("id").agg(F.count_distinct("line_id").alias("lines"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose line has no crop path for their view: children matched to siblings by
    the key of their common parent."""
    t = page_tables(spark, folder)
    line = ["page_key", "lines_no", "view"]
    crops = t["crops"].filter(~is_blank(F.col("path"))).select(*line)
    return t["sources"].select(*line, "id", "line_id", "name").join(crops, line, "left_anti").select("id", "line_id", "view", "name").distinct()


#: Line ids look alike wherever they stand in a payload.
SQL = {
    "p2_counts": """
    SELECT id, count(DISTINCT line_id) AS lines FROM (
      SELECT id, unnest(lines).line_id AS line_id FROM ocr_lines WHERE lines IS NOT NULL
      UNION ALL
      SELECT regexp_extract(line_id, '^(.*):', 1), line_id FROM (SELECT unnest(regexp_extract_all(payload, '"([0-9]+_[0-9]+:l[0-9]{4})"', 1)) AS line_id FROM ocr_raw))
    WHERE line_id IS NOT NULL GROUP BY id
    """,
}
