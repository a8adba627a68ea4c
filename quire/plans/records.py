"""Queries over manifests, journals, labels and page records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators import assemble, partition, resume, validate
from quire.sources.tables import table


def latest_attempt(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return resume.latest(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "ts")


def reusable_ok(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    return resume.reusable(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    newest = resume.latest(labels, ["id"], [F.col("written_at"), F.col("loaded_at"), F.coalesce("text", F.lit(""))])
    return newest.filter(F.col("verified") & ~is_blank(F.col("text")))


def pending_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return resume.pending(table(spark, folder, "samples").select("id", "document_id").distinct(), _labels(spark, folder), ["id"])


def finished_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return resume.finished(table(spark, folder, "samples").select("id", "document_id").distinct(), _labels(spark, folder), ["id"])


def dup_violations(spark: SparkSession, folder: str) -> DataFrame:
    return validate.duplicates(table(spark, folder, "samples"), 20, "unique:id", ["id"])


def manifest_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = validate.manifest_violations(table(spark, folder, "samples"), ["out"])
    return found.groupBy("rank", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


def doc_split_fd(spark: SparkSession, folder: str) -> DataFrame:
    return validate.determines(table(spark, folder, "samples"), 50, "document_in_one_split", "document_id", "split")


def hash_reused(spark: SparkSession, folder: str) -> DataFrame:
    return validate.same_hash_roles(table(spark, folder, "samples"), "out_sha256", "id")


def missing_labels(spark: SparkSession, folder: str) -> DataFrame:
    return validate.unmatched(table(spark, folder, "samples"), table(spark, folder, "labels"), "id").select("key", "detail")


def completeness_outer(spark: SparkSession, folder: str) -> DataFrame:
    pages, seen = table(spark, folder, "samples").select("id").distinct(), table(spark, folder, "ocr_lines").groupBy("id").agg(F.count(F.lit(1)).alias("readings"))
    joined = pages.withColumn("in_manifest", F.lit(True)).join(seen, "id", "full")
    return joined.select("id", F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"), F.coalesce("readings", F.lit(0)).alias("readings"))


def final_block_split(spark: SparkSession, folder: str) -> DataFrame:
    return partition.final_block(table(spark, folder, "samples"), "document_id", "page")


def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    crops = table(spark, folder, "prepare_ocr").distinct()
    b = [F.get("box", F.lit(i)) for i in range(4)]
    sound = (F.size("box") == 4) & (b[0] < b[2]) & (b[1] < b[3])
    width = F.when(sound, F.ceil((b[2] - b[0]).cast("double") * 48 / (b[3] - b[1])))
    return crops.groupBy(F.col("stage2_split").alias("role")).agg(
        F.count(F.lit(1)).alias("crops"), F.countDistinct("id").alias("pages"), F.max(F.length("text")).cast("bigint").alias("longest"), F.max(width).cast("bigint").alias("widest")
    )


def role_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each role, a row each, as a role may hold any number of them."""
    return table(spark, folder, "prepare_ocr").select(F.col("stage2_split").alias("role"), F.col("id").alias("page_id")).distinct()


def role_overlap(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "samples")
    return samples.filter("split = 'train'").select("document_id").intersect(samples.filter("split <> 'train'").select("document_id"))


def unlabelled_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "samples").select("id").subtract(table(spark, folder, "labels").select("id"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the newest reading of each page that has any."""
    rows = table(spark, folder, "ocr_lines").filter(F.size("lines") > 0)
    newest = resume.latest(rows.select("id", "fingerprint", "written_at", "lines"), ["id"], [F.col("written_at"), F.col("fingerprint")])
    return newest.select("id", F.explode("lines").alias("l")).select("id", "l.line_id", F.col("l.order").alias("ord"), "l.column_no", "l.box", "l.text", "l.raw_text", "l.status")


def context_window(spark: SparkSession, folder: str) -> DataFrame:
    out = assemble.context(_lines(spark, folder).select("id", "line_id", "ord", "column_no", F.coalesce("text", "raw_text").alias("text")), "id", "ord", "column_no", "text")
    return out.select("line_id", F.array_join("context", "|").alias("near"))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.ordered_text(_lines(spark, folder), ["id"], ["ord", "line_id"], "text", "\n", "[unread block]")


def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.status_rollup(_lines(spark, folder), ["id"], "status")


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return status_rollup(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def fingerprint_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return n.select("n_nationkey", resume.fingerprint(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("fingerprint"))


def first_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred pages of the manifest, by document, page and id."""
    rows = table(spark, folder, "samples").select("document_id", "page", "id").distinct()
    return resume.first_rows(rows, 100, [F.col("document_id").asc_nulls_last(), F.col("page").asc_nulls_last(), F.col("id").asc()])


def nested_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, sources and crops in all page records, summed over nested sizes."""
    rows = table(spark, folder, "ocr_lines").select(F.coalesce("lines", F.expr("array()").cast(table(spark, folder, "ocr_lines").schema["lines"].dataType)).alias("l"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    inner = lambda f: F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + size(x[f]))
    return rows.agg(F.sum(F.size("l").cast("bigint")).alias("lines"), F.sum(inner("sources")).alias("sources"), F.sum(inner("crops")).alias("crops"))


def set_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """One fingerprint of the pages of each role, whatever order and repeats they come in."""
    rows = table(spark, folder, "samples").select("split", "id").filter("split is not null and id is not null")
    return resume.set_fingerprint(rows, ["split"], F.col("id"))


_LINES = """lines AS (
  SELECT id, l.line_id AS line_id, l."order" AS ord, l.column_no AS column_no, l.box AS box, l.text AS text, l.raw_text AS raw_text, l.status AS status
  FROM (SELECT id, unnest(lines) AS l FROM (
    SELECT id, lines, row_number() OVER (PARTITION BY id ORDER BY written_at DESC, fingerprint DESC) AS k FROM ocr_lines WHERE len(lines) > 0) WHERE k = 1))"""
_LABELS = """done AS (
  SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY written_at DESC, loaded_at DESC, coalesce(text, '') DESC) AS k FROM labels)
  WHERE k = 1 AND verified AND length(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) > 0)"""
_ROWS = "SELECT {rank} AS rank, '{rule}' AS rule, id AS key FROM samples WHERE {where}"
_BLANK = "({c} IS NULL OR length(regexp_replace({c}, '\\s', '', 'g')) = 0)"

SQL = {
    "latest_attempt": "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "reusable_ok": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'",
    "pending_jobs": f"WITH {_LABELS} SELECT DISTINCT id, document_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.id = s.id)",
    "finished_jobs": f"WITH {_LABELS} SELECT DISTINCT id, document_id FROM samples s WHERE EXISTS (SELECT 1 FROM done d WHERE d.id = s.id)",
    "dup_violations": "SELECT 20 AS rank, 'unique:id' AS rule, coalesce(id, '~') AS key, count(*)::VARCHAR AS detail FROM samples GROUP BY id HAVING count(*) > 1",
    "manifest_violations": "SELECT rank, rule, count(*) AS n, min(key) AS first_key FROM ("
    + " UNION ALL ".join(_ROWS.format(rank=10, rule=f"required:{c}", where=_BLANK.format(c=c)) for c in ("id", "document_id", "deblur_run", "split", '"out"')).replace('required:"out"', "required:out")
    + " UNION ALL SELECT 20, 'unique:id', coalesce(id, '~') FROM samples GROUP BY id HAVING count(*) > 1"
    + " UNION ALL " + _ROWS.format(rank=30, rule="domain:split", where="split NOT IN ('train','validation','test','demo')")
    + " UNION ALL " + _ROWS.format(rank=40, rule="held_out", where="document_id IN ('0','4','14') AND split IN ('train','validation')")
    + " UNION ALL SELECT 50, 'document_in_one_split', document_id FROM samples WHERE document_id IS NOT NULL GROUP BY document_id HAVING min(split) < max(split)"
    + " UNION ALL " + _ROWS.format(rank=60, rule="domain:stage2_split", where="stage2_split NOT IN ('train','validation','evaluation','unassigned')")
    + " UNION ALL SELECT 70, 'one_run', min(deblur_run) || ',' || max(deblur_run) FROM samples HAVING min(deblur_run) < max(deblur_run)"
    + ") GROUP BY rank, rule",
    "first_samples": "SELECT document_id, page, id FROM (SELECT DISTINCT document_id, page, id FROM samples) ORDER BY document_id NULLS LAST, page NULLS LAST, id LIMIT 100",
    "nested_totals": "SELECT sum(len(lines))::BIGINT AS lines, sum(list_sum(list_transform(lines, lambda x: coalesce(len(x.sources), 0))))::BIGINT AS sources, sum(list_sum(list_transform(lines, lambda x: coalesce(cardinality(x.crops), 0)::BIGINT)))::BIGINT AS crops FROM ocr_lines",
    "set_fingerprints": "SELECT split, count(*) AS members, sha256(sum(('0x' || left(sha256(id), 15))::BIGINT)::VARCHAR || ':' || count(*)) AS fingerprint FROM (SELECT DISTINCT split, id FROM samples WHERE split IS NOT NULL AND id IS NOT NULL) GROUP BY split",
    "doc_split_fd": "SELECT 50 AS rank, 'document_in_one_split' AS rule, document_id AS key, min(split) || ',' || max(split) AS detail FROM samples WHERE document_id IS NOT NULL GROUP BY document_id HAVING min(split) < max(split)",
    "hash_reused": "SELECT 70 AS rank, 'content_in_one_role' AS rule, out_sha256 AS key, min(id) || ',' || max(id) AS detail FROM samples WHERE out_sha256 IS NOT NULL GROUP BY out_sha256 HAVING min(id) < max(id)",
    "missing_labels": "SELECT coalesce(a.id, b.id) AS key, CASE WHEN a.id IS NULL THEN 'right_only' ELSE 'left_only' END AS detail FROM (SELECT DISTINCT id FROM samples) a FULL JOIN (SELECT DISTINCT id FROM labels) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL",
    "completeness_outer": "SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_manifest, coalesce(readings, 0) AS readings FROM (SELECT DISTINCT id FROM samples) a FULL JOIN (SELECT id, count(*) AS readings FROM ocr_lines GROUP BY id) b ON a.id = b.id",
    "final_block_split": """SELECT document_id, page, CASE WHEN row_number() OVER (PARTITION BY document_id ORDER BY page DESC)
        <= least(count(*) OVER (PARTITION BY document_id) - 1, greatest(1, ceil((count(*) OVER (PARTITION BY document_id))::DOUBLE * 0.2::DOUBLE))) THEN 'validation' ELSE 'train' END AS role
        FROM (SELECT DISTINCT document_id, page FROM samples WHERE document_id IS NOT NULL AND page IS NOT NULL)""",
    "split_summary": """SELECT stage2_split AS role, count(*) AS crops, count(DISTINCT id) AS pages, max(length(text))::BIGINT AS longest,
        max(CASE WHEN len(box) = 4 AND box[1] < box[3] AND box[2] < box[4] THEN ceil((box[3] - box[1])::DOUBLE * 48 / (box[4] - box[2])) END)::BIGINT AS widest
        FROM (SELECT DISTINCT * FROM prepare_ocr) GROUP BY stage2_split""",
    "role_pages": "SELECT DISTINCT stage2_split AS role, id AS page_id FROM prepare_ocr",
    "role_overlap": "SELECT document_id FROM samples WHERE split = 'train' INTERSECT SELECT document_id FROM samples WHERE split <> 'train'",
    "unlabelled_pages": "SELECT id FROM samples EXCEPT SELECT id FROM labels",
    "context_window": f"""WITH {_LINES}, w AS (SELECT line_id, ord, column_no, list(struct_pack(o := ord, c := column_no, t := coalesce(text, raw_text))) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM lines)
        SELECT line_id, array_to_string(list_transform(list_filter(f, lambda x: x.c IS NOT DISTINCT FROM column_no AND x.o IS DISTINCT FROM ord), lambda x: x.t), '|') AS near FROM w""",
    "page_text": f"WITH {_LINES} SELECT id, string_agg(coalesce(text, '[unread block]'), chr(10) ORDER BY ord, line_id) AS text FROM lines GROUP BY id",
    "status_rollup": f"WITH {_LINES} SELECT id, ['ok','review','error','pending'][max(CASE status WHEN 'ok' THEN 1 WHEN 'review' THEN 2 WHEN 'error' THEN 3 ELSE 4 END)] AS status FROM lines GROUP BY id",
    "status_counts": f"WITH {_LINES}, r AS (SELECT id, ['ok','review','error','pending'][max(CASE status WHEN 'ok' THEN 1 WHEN 'review' THEN 2 WHEN 'error' THEN 3 ELSE 4 END)] AS status FROM lines GROUP BY id) SELECT status, count(*) AS pages FROM r GROUP BY status",
    "fingerprint_rows": """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS fingerprint FROM nation""",
}

ALL = (
    latest_attempt, reusable_ok, pending_jobs, finished_jobs, dup_violations, manifest_violations, doc_split_fd, hash_reused, missing_labels, completeness_outer,
    final_block_split, split_summary, role_pages, role_overlap, unlabelled_pages, context_window, page_text, status_rollup, status_counts, fingerprint_rows,
    first_samples, nested_totals, set_fingerprints,
)
