"""Queries of the training-text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import cutting, mixing, packing, reading, scans, splits
from quire.session import new_scratch
from quire.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


LABEL_LIMIT, LABEL_OVERLAP = 1_500, 150


def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = cutting.current_labels(table(spark, folder, "labels"))
    return cutting.split_texts(labels, "id", "text", LABEL_LIMIT, LABEL_OVERLAP)


def p1_crops(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.split_crops(table(spark, folder, "prepare_ocr"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that the splitter cut, by table. Pieces' texts aren't read for it."""
    labels = cutting.split_texts(cutting.current_labels(table(spark, folder, "labels")), "id", "text", LABEL_LIMIT, LABEL_OVERLAP, texts=False)
    crops = cutting.split_crops(table(spark, folder, "prepare_ocr"), texts=False)
    labels = labels.filter("n_pieces > 1").select(F.lit("labels").alias("item_table"), F.col("id").alias("item_id"))
    crops = crops.filter("n_pieces > 1").select(F.lit("prepare_ocr").alias("item_table"), F.col("image").alias("item_id"))
    return labels.union(crops).distinct()


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each current label: how far its pieces reach, whether they leave no gap and keep to
    the limit and the overlap, and whether their texts are those of their places."""
    pieces = p1_labels(spark, folder)
    line = Window.partitionBy("id").orderBy("piece_no")
    behind = F.lag("end").over(line)
    joined = (F.col("start") <= F.coalesce(behind, F.lit(0))) & (F.coalesce(behind, F.lit(0)) - F.col("start") <= LABEL_OVERLAP)
    fits = (F.col("end") - F.col("start") <= LABEL_LIMIT) & (F.length("piece") == F.col("end") - F.col("start"))
    rows = pieces.withColumn("_ok", joined & fits & (F.col("piece_no") == F.row_number().over(line) - 1))
    return rows.groupBy("id").agg(F.max("end").alias("n_chars"), F.bool_and("_ok").alias("sound"))


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """All label texts as large files, cut by byte range: the characters of all pieces, and
    pieces beyond the limit."""
    texts = new_scratch(spark, "files")
    table(spark, folder, "labels").select(F.coalesce("text", F.lit("")).alias("text")).write.text(texts)
    pieces = cutting.split_files(spark, f"{texts}/*.txt", LABEL_LIMIT, LABEL_OVERLAP)
    ends = pieces.groupBy("path").agg(F.max("end").alias("n"), F.count_if(F.col("end") - F.col("start") > LABEL_LIMIT).alias("over"))
    return ends.agg(F.sum("n").alias("n_chars"), F.sum("over").alias("over_limit"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.Repairs(table(spark, folder, "ocr_lines"), table(spark, folder, "lexicon")).found()


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.Repairs(table(spark, folder, "ocr_lines"), table(spark, folder, "lexicon")).paragraphs()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.disagreeing(splits.sample_groups(table(spark, folder, "samples")))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_samples(table(spark, folder, "samples"))


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each old split that got a new one, and how many of them lie in a group of which
    other rows got another."""
    rows = p4_splits(spark, folder)
    crossing = rows.filter("group_id is not null").groupBy("group_id").agg(F.min("new_split").alias("a"), F.max("new_split").alias("b")).filter("a <> b").select("group_id", F.lit(1).alias("_c"))
    rows = rows.join(crossing, "group_id", "left")
    return rows.groupBy("old_split").agg(F.count("new_split").alias("rows"), F.count("_c").alias("crossing"))


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of each document that are in a container, from its pieces."""
    packed = p6_packed(spark, folder)
    size = F.when(F.col("container").isNotNull(), F.col("char_end") - F.col("char_start"))
    return packed.groupBy("doc_id").agg(F.coalesce(F.sum(size), F.lit(0)).alias("n_chars"))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the packer had to place in several containers."""
    return packing.oversized(p6_packed(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(p6_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = mixing.sized_documents(spread(table(spark, folder, "documents").select("doc_id", "source", "text")))
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(sized, targets), sized, targets


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of which the mix holds every copy it may, and is still below the target."""
    return mixing.mix_report(*_mixed(spark, folder)).filter("short").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(*_mixed(spark, folder))


def _read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, reading.LanguageOdds]:
    documents = table(spark, folder, "documents")
    return spread(documents.select("doc_id", "text")), reading.fit_language(documents)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, odds = _read_documents(spark, folder)
    return reading.university(documents, odds).distinct()


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    documents, odds = _read_documents(spark, folder)
    return reading.profile(documents, odds=odds)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_labels, p1_crops, p1_cover, p1_files, p3_found, p3_paragraphs, p4_found, p4_splits, p4_cover, p6_found, p6_cover, p6_packed, p6_report, p7_found, p7_mix, p7_report, p8_found, p8_levels)
}
# Blanks as Python's str.strip knows them, and the ASCII form, in SQL.
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ASCII = "translate(translate(translate(translate(text, '‘’‚‛', repeat(chr(39), 4)), '“”„‟', repeat(chr(34), 4)), '‐‑‒–—−' || chr(173), '-------'), chr(160), ' ')"
for _wide, _letters in (("…", "..."), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    _ASCII = f"replace({_ASCII}, '{_wide}', '{_letters}')"

#: Sizes are clear of the limits of problems 6 and 7 by a wide margin, so that characters tell
#: the same as tokens: 10,000 characters are more than 2,048 tokens and less than any text just
#: beyond them has, and shares of sources in characters are their shares in tokens.
SQL: dict[str, str] = {
    "p1_found": f"""
    WITH newest AS (SELECT id, arg_max(struct_pack(t := text, v := coalesce(verified, false)), written_at) AS l FROM labels GROUP BY id),
    crops AS (SELECT image, box, trim(regexp_replace({_ASCII}, '{_BLANKS}+', ' ', 'g')) AS line FROM prepare_ocr),
    measured AS (
      SELECT image, coalesce(length(line) + len(list_filter(range(1, length(line)), lambda i: line[i] = line[i + 1])), 0) AS steps,
             coalesce(len(box) = 4 AND box[1] < box[3] AND box[2] < box[4] AND box[3] - box[1] > 20 * (box[4] - box[2]), false) AS wide
      FROM crops)
    SELECT 'labels' AS item_table, id AS item_id FROM newest
    WHERE l.v AND length(regexp_replace(l.t, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) > 1500
    UNION
    SELECT 'prepare_ocr', image FROM measured WHERE steps > 40 OR wide
    """,
    "p1_cover": f"""
    WITH newest AS (SELECT id, arg_max(struct_pack(t := text, v := coalesce(verified, false)), written_at) AS l FROM labels GROUP BY id)
    SELECT id, coalesce(length(regexp_replace(l.t, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), 0) AS n_chars, true AS sound FROM newest WHERE l.v
    """,
    "p1_files": "SELECT sum(length(coalesce(text, '')) + 1)::BIGINT AS n_chars, 0::BIGINT AS over_limit FROM labels",
    "p4_cover": "SELECT split AS old_split, count(*) AS rows, 0::BIGINT AS crossing FROM samples GROUP BY split",
    "p6_cover": "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars FROM documents",
    "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE length(text) > 10000",
    "p7_found": """
    WITH d AS (SELECT regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g') AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
    SELECT t.source FROM mix_targets t LEFT JOIN d USING (source)
    WHERE coalesce(d.n, 0) * t.max_repeats < t.target_share * (SELECT sum(length(text)) FROM documents)
    """,
    "p4_found": """
    WITH RECURSIVE plain AS (
      SELECT id, split, regexp_extract(regexp_replace(translate(document_id, '０１２３４５６７８９．', '0123456789.'), '([0-9])[.]0+([^0-9.]|$)', '\\1\\2'), '[0-9]+') AS n,
             lower(trim(document_uid)) AS u, out_sha256 AS s FROM samples),
    keys AS (
      SELECT id, split, CASE WHEN n <> '' THEN 'n' || regexp_replace(n, '^0+([0-9])', '\\1') END AS n,
             CASE WHEN u NOT IN ('', '-', 'n/a', 'unknown', 'tbd', 'pending', 'none', 'null') AND NOT regexp_full_match(u, '0+') THEN 'u' || u END AS u, 's' || s AS s FROM plain),
    ties AS (SELECT DISTINCT n AS a, u AS b FROM keys UNION SELECT DISTINCT n, s FROM keys UNION SELECT DISTINCT u, s FROM keys),
    edges AS (SELECT a, b FROM ties WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM ties WHERE a IS NOT NULL AND b IS NOT NULL),
    nodes AS (SELECT n AS k FROM keys UNION SELECT u FROM keys UNION SELECT s FROM keys),
    reach AS (SELECT k, k AS r FROM nodes WHERE k IS NOT NULL AND NOT starts_with(k, 's') UNION SELECT k, b FROM reach JOIN edges ON r = a),
    marks AS (SELECT k, min(r) AS c FROM (SELECT k, r FROM reach UNION ALL SELECT r, k FROM reach) GROUP BY k),
    rows_ AS (SELECT id, split, coalesce((SELECT c FROM marks WHERE k = coalesce(n, u, s)), coalesce(n, u, s)) AS c FROM keys WHERE coalesce(n, u, s) IS NOT NULL),
    mixed AS (SELECT c, min(id) AS group_id FROM rows_ GROUP BY c HAVING count(DISTINCT split) > 1)
    SELECT DISTINCT group_id, id FROM rows_ JOIN mixed USING (c)
    """,
}
