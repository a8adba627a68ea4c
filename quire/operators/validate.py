"""Validation as violation rows (rank, rule, key, detail).

A rule never drops or changes rows: it lists what is wrong, and `enforce` raises on the
lowest-ranked rule that was broken. Rules see whole tables; a filter comes after them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ctc_steps, is_blank, printable_ascii, strip_blanks

SPLITS = ("train", "validation", "test", "demo")
ROLES = ("train", "validation", "evaluation", "unassigned")


class Violated(ValueError):
    """The first broken rule, with examples."""


def violations(df: DataFrame, rank: int, rule: str, broken: Column, key: Column, detail: Column | None = None) -> DataFrame:
    """Rows of `df` for which `broken` is true; a null condition is not a violation."""
    return df.filter(F.coalesce(broken, F.lit(False))).select(
        F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")
    )


def duplicates(df: DataFrame, rank: int, rule: str, keys: list[str]) -> DataFrame:
    """One violation for each key that occurs more than once; null keys are compared too."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return violations(counts, rank, rule, F.lit(True), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]), F.col("_n"))


def determines(df: DataFrame, rank: int, rule: str, left: str, right: str) -> DataFrame:
    """Values of `left` that occur with more than one non-null value of `right`."""
    spread = df.filter(F.col(left).isNotNull()).groupBy(left).agg(F.min(right).alias("_lo"), F.max(right).alias("_hi"))
    return violations(spread, rank, rule, F.col("_lo") < F.col("_hi"), F.col(left), F.concat_ws(",", "_lo", "_hi"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(found: DataFrame) -> None:
    """Raise on the lowest-ranked violation, naming up to five of its keys."""
    worst = found.orderBy("rank", "rule", "key").limit(5).collect()
    if worst:
        same = [r for r in worst if r["rank"] == worst[0]["rank"]]
        raise Violated(f"{same[0]['rule']}: " + ", ".join(f"{r['key']} ({r['detail']})" for r in same))


# ---------------------------------------------------------------- manifests


def check_views(views: list[str], known: tuple[str, ...] = ("blur", "out")) -> list[str]:
    """A nonempty list of known views, without repeats, or an error."""
    if not views or set(views) - set(known) or len(set(views)) != len(views):
        raise ValueError(f"views must be some of {known}")
    return views


def checked(df: DataFrame, rules: list[tuple[int, str, Column, Column | None]], key: Column) -> DataFrame:
    """Violations of rules about single rows (rank, rule, broken, detail), in one pass."""

    def row(rank: int, rule: str, broken: Column, detail: Column | None) -> Column:
        said = (detail if detail is not None else F.lit(None)).cast("string")
        return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), said.alias("detail")))

    found = F.filter(F.array(*[row(*r) for r in rules]), lambda x: x.isNotNull())
    return df.select(F.explode(found).alias("v")).select("v.*")


def manifest_violations(samples: DataFrame, views: list[str], held_out: tuple[str, ...] = ("0", "4", "14")) -> DataFrame:
    """All rules of the page manifest: required fields, unique ids, known splits and roles,
    held-out documents, one split a document, one run. Rules about single rows share one
    scan; only the others exchange rows."""
    key = F.col("id")
    need = ["id", "document_id", "deblur_run", "split", *check_views(views)]
    rules = [(10, f"required:{c}", is_blank(F.col(c).cast("string")), None) for c in need]
    rules.append((30, "domain:split", ~F.col("split").isin(*SPLITS), F.col("split")))
    rules.append((40, "held_out", F.col("document_id").isin(*held_out) & F.col("split").isin("train", "validation"), F.col("split")))
    rules.append((60, "domain:stage2_split", ~F.col("stage2_split").isin(*ROLES), F.col("stage2_split")))
    parts = [checked(samples, rules, key), duplicates(samples, 20, "unique:id", ["id"]), determines(samples, 50, "document_in_one_split", "document_id", "split")]
    return union_all([*parts, one_value(samples, 70, "one_run", "deblur_run")])


def one_value(df: DataFrame, rank: int, rule: str, col: str) -> DataFrame:
    """A violation if a column holds more than one non-null value."""
    span = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return violations(span, rank, rule, F.col("_lo") < F.col("_hi"), F.concat_ws(",", "_lo", "_hi"))


def known_documents(wanted: list[str], samples: DataFrame) -> DataFrame:
    """Violations for wanted documents that the manifest lacks."""
    asked = samples.sparkSession.createDataFrame([(w,) for w in wanted], "document_id string")
    missing = asked.join(samples.select("document_id").distinct(), "document_id", "left_anti")
    return violations(missing, 5, "unknown_document", F.lit(True), F.col("document_id"))


# ---------------------------------------------------------------- labels and crops


def label_line_violations(lines: DataFrame, steps: int = 40) -> DataFrame:
    """Rules for supervised lines (id, text, complete, box, page_size): complete, printable
    ASCII without outer blanks, within the capacity, a finite box inside the page of at
    least 2 px a side after rounding outwards, and no two lines with one crop box."""
    key = F.col("id")
    b = [F.get("box", F.lit(i)) for i in range(4)]
    sound = F.coalesce((F.size("box") == 4) & F.forall("box", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    inside = (b[0] >= 0) & (b[1] >= 0) & (b[2] <= F.get("page_size", F.lit(0))) & (b[3] <= F.get("page_size", F.lit(1))) & (b[0] < b[2]) & (b[1] < b[3])
    wide = (F.ceil(b[2]) - F.floor(b[0]) >= 2) & (F.ceil(b[3]) - F.floor(b[1]) >= 2)
    parts = [
        violations(lines, 10, "complete", ~F.coalesce(F.col("complete"), F.lit(False)), key),
        violations(lines, 20, "text", ~printable_ascii(F.col("text")) | (strip_blanks(F.col("text")) != F.col("text")), key, F.col("text")),
        violations(lines, 30, "capacity", ctc_steps(F.col("text")) > steps, key, ctc_steps(F.col("text"))),
        violations(lines, 40, "box", ~sound | ~F.coalesce(inside, F.lit(False)), key),
        violations(lines, 50, "box_size", sound & ~wide, key),
    ]
    crop = lines.filter(sound).select("id", F.concat_ws(",", F.floor(b[0]), F.floor(b[1]), F.ceil(b[2]), F.ceil(b[3])).alias("crop"))
    return union_all([*parts, duplicates(crop, 60, "unique:crop", ["id", "crop"])])


LABEL_STATES = ("geometry_checked", "human_checked")


def label_page_violations(labels: DataFrame, samples: DataFrame, adaptation: str = "4", steps: int = 40) -> DataFrame:
    """Rules for labelled pages (id, out_sha256, page_size, label_status, provenance struct of
    method and source_sha256, lines array of struct box, text, complete) against their
    samples (id, document_id, out_sha256, page_size): a known page of the adaptation
    document, the same picture and size, a checked state, a named method with a hash, some
    lines, and the rules for lines (label_line_violations)."""
    page = samples.select("id", F.col("document_id").alias("_document"), F.col("out_sha256").alias("_sha"), F.col("page_size").alias("_size"), F.lit(True).alias("_known")).dropDuplicates(["id"])
    rows = labels.join(page, "id", "left")
    known = F.coalesce("_known", F.lit(False))
    rules = [
        (1, "unknown_page", ~known, None),
        (2, "document", known & ~F.coalesce(F.col("_document") == adaptation, F.lit(False)), F.col("_document")),
        (3, "picture", known & ~F.col("out_sha256").eqNullSafe(F.col("_sha")), F.col("out_sha256")),
        (4, "page_size", known & ~F.col("page_size").eqNullSafe(F.col("_size")), None),
        (5, "label_status", ~F.coalesce(F.col("label_status").isin(*LABEL_STATES), F.lit(False)), F.col("label_status")),
        (6, "provenance", is_blank(F.col("provenance.method")) | ~F.coalesce(F.col("provenance.source_sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), F.col("provenance.method")),
        (7, "lines", F.coalesce(F.size("lines"), F.lit(0)) <= 0, None),
    ]
    lines = labels.select("id", "page_size", F.explode("lines").alias("l")).select("id", "page_size", "l.box", "l.text", "l.complete")
    return union_all([checked(rows, rules, F.col("id")), label_line_violations(lines, steps)])


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """Rules for character evidence (line_id, probs array<array<double>>, alphabet, blank_id,
    excluded_mass): rectangular, one empty blank, distinct single characters, values in
    0..1, rows of mass at most 1.0001, and with the excluded mass 1 within 2e-4."""
    key = F.col("line_id")
    width = F.size("alphabet")
    blank = F.get("alphabet", F.col("blank_id").cast("int"))
    signs = F.filter("alphabet", lambda c, i: i != F.col("blank_id"))
    mass = F.transform("probs", lambda r: F.aggregate(r, F.lit(0.0).cast("double"), lambda a, p: a + p.cast("double")))
    sums = F.zip_with(mass, F.col("excluded_mass"), lambda a, b: F.abs(a + b - 1.0) <= F.lit(2e-4 + 1e-5))
    return union_all(
        [
            violations(evidence, 10, "shape", ~F.forall("probs", lambda r: F.size(r) == width), key),
            violations(evidence, 20, "blank", F.coalesce(blank != "", F.lit(True)) | (F.size(F.filter("alphabet", lambda c: c == "")) != 1), key),
            violations(evidence, 30, "alphabet", (F.size(F.array_distinct("alphabet")) != width) | ~F.forall(signs, lambda c: F.length(c) == 1), key),
            violations(evidence, 40, "range", ~F.forall("probs", lambda r: F.forall(r, lambda p: F.coalesce(~F.isnan(p) & (p >= 0) & (p <= 1), F.lit(False)))), key),
            violations(evidence, 50, "mass", ~F.forall(mass, lambda m: m <= 1.0001), key),
            violations(evidence, 60, "excluded", F.col("excluded_mass").isNotNull() & ((F.size("excluded_mass") != F.size("probs")) | ~F.forall("excluded_mass", lambda e: e >= -1e-5) | ~F.coalesce(F.forall(sums, lambda ok: ok), F.lit(False))), key),
        ]
    )


def same_hash_roles(df: DataFrame, hash_col: str, role_col: str, rank: int = 70) -> DataFrame:
    """Identical content that occurs in more than one role."""
    return determines(df, rank, "content_in_one_role", hash_col, role_col)


def unmatched(left: DataFrame, right: DataFrame, key: str, rank: int = 80) -> DataFrame:
    """Keys on one side only: a full-outer completeness check."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    lone = a.join(b, key, "full").filter("_l is null or _r is null")
    return violations(lone, rank, "unmatched", F.lit(True), F.col(key), F.when(F.col("_l").isNull(), "right_only").otherwise("left_only"))
