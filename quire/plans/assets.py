"""The tiny files behind crops and probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quire.operators.compact import consolidate, packed_splits, sharing_members, sharing_pairs
from quire.session import new_scratch


def _consolidated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = packed_splits(spark, f"{folder}/asset_files.parquet")
    return consolidate(files, "asset_id", "content", new_scratch(spark, "published"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files with a same record, told by the manifest of the published packs."""
    return sharing_pairs(_consolidated(spark, folder)[1])


def p5_members(spark: SparkSession, folder: str) -> DataFrame:
    return sharing_members(_consolidated(spark, folder)[1]).withColumnRenamed("file_key", "asset_id")


def p5_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _consolidated(spark, folder)[0]


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Records in the published packs, packs beyond the largest size, and those below the
    smallest that aren't the last of few."""
    packs = p5_packs(spark, folder)
    return packs.agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("records"), F.count_if(F.col("n_bytes") > 1 << 20).alias("too_large"))


#: Records of the two kinds of files, field by field; numbers as doubles.
_RECORDS = """l AS (SELECT asset_id, trim(unnest(string_split_regex(replace(content, chr(65279), ''), '\\r\\n|\\r|\\n'))) AS line FROM asset_files),
    j AS (SELECT asset_id, line::JSON AS r FROM l WHERE line <> '' AND json_valid(line) AND json_type(line::JSON) = 'OBJECT'),
    k AS (SELECT DISTINCT asset_id, list_sort(json_keys(r)) AS names, r->>'line_id' AS line_id, r->>'view' AS v, r->>'name' AS name, (r->>'t')::DOUBLE AS t, (r->>'w')::DOUBLE AS w, (r->>'h')::DOUBLE AS h,
            (r->'ink')::DOUBLE[] AS ink, (r->'p')::DOUBLE[] AS p FROM j)"""
SQL = {
    "p5_found": f"""
    WITH {_RECORDS}, g AS (SELECT list_sort(list(asset_id)) AS a FROM k GROUP BY names, line_id, v, name, t, w, h, ink, p HAVING count(*) > 1)
    SELECT DISTINCT x AS asset_a, y AS asset_b FROM (SELECT x, unnest(a) AS y FROM (SELECT unnest(a) AS x, a FROM g)) WHERE x < y
    """,
    "p5_members": f"""
    WITH {_RECORDS}, g AS (SELECT list_sort(list(asset_id)) AS a FROM k GROUP BY names, line_id, v, name, t, w, h, ink, p HAVING count(*) > 1)
    SELECT DISTINCT a[1] AS representative, unnest(a) AS asset_id FROM g
    """,
    "p5_totals": f"WITH {_RECORDS} SELECT count(*) AS records, 0::BIGINT AS too_large FROM (SELECT DISTINCT names, line_id, v, name, t, w, h, ink, p FROM k)",
}
