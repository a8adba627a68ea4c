"""Guards between stages: each gives violation rows over the two sides it compares."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ctc_steps, is_blank, printable_ascii
from quire.operators.resume import fingerprint_of
from quire.operators.validate import determines, duplicates, union_all, unmatched, violations

# ---------------------------------------------------------------- paths


def resolved(path: Column, folder: str) -> Column:
    """A path as it is if absolute, else under `folder`; null stays null."""
    return F.when(path.startswith("/") | path.rlike(r"\A[a-z]+://"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def relative(path: Column, folder: str) -> Column:
    """A path below `folder` relative to it, in forward slashes; others stay."""
    base = folder.rstrip("/") + "/"
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)


def missing_files(named: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Violations for named paths that `files` (path) lacks."""
    lone = named.select(path).filter(F.col(path).isNotNull()).distinct().join(files.select(F.col("path").alias(path)), path, "left_anti")
    return violations(lone, 15, "missing_file", F.lit(True), F.col(path))


# ---------------------------------------------------------------- evidence and caches


def evidence_guards(samples: DataFrame, pages: DataFrame, alphabet: str) -> DataFrame:
    """What keeps a page (id, document_id, status, schema_version, out_sha256, page_size,
    alphabet, lines array<struct<line_id, order, box>>) from being recovered: it isn't
    read well, or isn't the sample's, or its lines clash or leave the page."""
    key = F.col("id")
    both = pages.alias("p").join(samples.select("id", F.col("document_id").alias("_doc"), F.col("out_sha256").alias("_sha")).distinct(), "id", "left")
    box = lambda x, i: F.get(x["box"], F.lit(i))
    outside = F.exists("lines", lambda x: ~F.coalesce((F.size(x["box"]) == 4) & (box(x, 0) >= 0) & (box(x, 1) >= 0) & (box(x, 0) < box(x, 2)) & (box(x, 1) < box(x, 3)) & (box(x, 2) <= F.col("page_size")[0]) & (box(x, 3) <= F.col("page_size")[1]), F.lit(False)))
    orders = F.transform("lines", lambda x: x["order"])
    letters = lambda c: F.array_sort(F.array_distinct(F.split(c, "")))
    lines = pages.select("id", F.explode("lines").alias("l")).select(F.col("l.line_id").alias("line_id"))
    return union_all(
        [
            unmatched(samples, pages, "id", 10),
            violations(both, 20, "page_not_read", ~F.col("status").isin("ok", "review") | (F.col("schema_version") < 2), key, F.col("status")),
            violations(both, 30, "other_document", ~F.col("document_id").eqNullSafe(F.col("_doc")), key, F.col("_doc")),
            violations(both, 40, "other_image", ~F.col("out_sha256").eqNullSafe(F.col("_sha")), key),
            violations(both, 50, "other_alphabet", ~letters(F.col("alphabet")).eqNullSafe(letters(F.lit(alphabet))), key),
            violations(both, 60, "repeated_order", F.size(F.array_distinct(orders)) != F.size(orders), key),
            violations(both, 70, "box_outside", outside, key),
            duplicates(lines, 80, "unique:line_id", ["line_id"]),
        ]
    )


def compatible_detections(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cached detections (fingerprint, position, image_sha256, detector, settings, view, ...)
    that hold for the wanted pages (image_sha256, detector, settings): of the view `out`,
    one a fingerprint, at its first position with its last content."""
    fits = cached.filter("view = 'out'").join(wanted.select("image_sha256", "detector", "settings").distinct(), ["image_sha256", "detector", "settings"], "left_semi")
    row = F.struct(*[F.col(c) for c in fits.columns if c != "position"])
    return fits.groupBy("fingerprint").agg(F.min("position").alias("position"), F.max_by(row, "position").alias("_r")).select("position", "_r.*")


def export_guard(training: Mapping[str, Any], claimed: str, files: Mapping[str, str], exported: Mapping[str, str]) -> list[str]:
    """What is wrong with an exported model: its training record isn't the one claimed, or
    its files aren't those that were exported."""
    wrong = [] if fingerprint_of(dict(training)) == claimed else ["training_fingerprint"]
    return wrong + sorted(f"file:{k}" for k in exported.keys() | files.keys() if exported.get(k) != files.get(k))


def role_guard(rows: DataFrame, dataset: DataFrame) -> DataFrame:
    """Pages (id, stage2_split, out_sha256) whose role or picture isn't that of the dataset."""
    known = dataset.select("id", F.col("stage2_split").alias("_role"), F.col("out_sha256").alias("_sha")).distinct()
    both = rows.join(known, "id", "left")
    return union_all(
        [
            violations(both, 10, "role_changed", ~F.col("stage2_split").eqNullSafe(F.col("_role")), F.col("id"), F.col("_role")),
            violations(both, 20, "image_changed", ~F.col("out_sha256").eqNullSafe(F.col("_sha")), F.col("id")),
        ]
    )


# ---------------------------------------------------------------- data sets


def dataset_guards(crops: DataFrame, pages: DataFrame, adaptation: str = "4", steps: int = 40) -> DataFrame:
    """Rules of a prepared set: crops (image, role, text, sha256) and pages (id, document_id,
    role). Roles share no page and each has some; training pages are of the adaptation
    document; a crop's name starts with a page of its role; no crop twice; texts printable
    and within the capacity; no picture in two roles."""
    roles = pages.select("role").distinct()
    need = pages.sparkSession.createDataFrame([("train",), ("validation",)], "role string")
    lone = need.join(roles, "role", "left_anti")
    named = crops.withColumn("_page", F.regexp_extract("image", r"([^/]*)_[^_/]*\z", 1))
    stray = named.join(pages.select(F.col("id").alias("_page"), "role").distinct(), ["_page", "role"], "left_anti")
    return union_all(
        [
            determines(pages, 10, "page_in_one_role", "id", "role"),
            violations(lone, 20, "empty_role", F.lit(True), F.col("role")),
            violations(pages, 30, "adaptation_document", F.col("role").isin("train", "validation") & ~((F.col("document_id") == adaptation) & F.col("id").startswith(f"{adaptation}_")), F.col("id"), F.col("document_id")),
            violations(stray, 40, "crop_without_page", F.lit(True), F.col("image")),
            violations(crops, 45, "path", F.col("image").startswith("/") | F.col("image").rlike(r"(\A|/)\.\.(/|\z)"), F.col("image")),
            duplicates(crops, 50, "unique:image", ["image"]),
            violations(crops, 60, "characters", ~printable_ascii(F.col("text")), F.col("image")),
            violations(crops, 70, "capacity", ctc_steps(F.col("text")) > steps, F.col("image")),
            determines(crops, 80, "picture_in_one_role", "sha256", "role"),
        ]
    )


def total_guards(crops: DataFrame, counts: dict[str, int], max_text_length: int, max_aspect_ratio: float) -> DataFrame:
    """What a set's metadata say of it against its crops (role, text, width, height): crops of
    each role, the longest text and the widest ratio."""
    spark = crops.sparkSession
    want = spark.createDataFrame([*counts.items()] or [(None, None)], "role string, n long").filter("role is not null")
    have = crops.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    sides = want.join(have, "role", "full")
    span = crops.agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("_long"), F.coalesce(F.max(F.col("width") / F.col("height")), F.lit(0.0)).alias("_wide"))
    return union_all(
        [
            violations(sides, 90, "count", F.coalesce("n", F.lit(0)) != F.coalesce("_n", F.lit(0)), F.col("role"), F.concat_ws(" for ", F.coalesce("_n", F.lit(0)).cast("string"), F.coalesce("n", F.lit(0)).cast("string"))),
            violations(span, 91, "max_text_length", F.col("_long") != max_text_length, F.col("_long")),
            violations(span, 92, "max_aspect_ratio", F.abs(F.col("_wide") - F.lit(float(max_aspect_ratio))) > 1e-9, F.col("_wide")),
        ]
    )


def training_guards(rows: DataFrame, template: str, splits: tuple[str, ...] = ("train", "validation"), held_out: tuple[str, ...] = ("0", "4", "14")) -> DataFrame:
    """Rules of training examples (id, document_id, deblur_run, split, image array<string>,
    conversations array<struct<from, value>>): an allowed split, a run, two absolute
    pictures, a prompt and its answer, the prompt by the template, an answer that isn't
    blank; no document in two splits. Where the rows have `prompt`, the whole turn made of the
    template and the two readings, it must be that; where they have source_hashes and
    known_hashes (maps by view), these must agree."""
    key = F.col("id")
    turn = lambda i, f: F.get("conversations", F.lit(i)).getField(f)
    return union_all(
        [
            duplicates(rows, 10, "unique:id", ["id"]),
            violations(rows, 20, "split", ~F.coalesce(F.col("split").isin(*splits), F.lit(False)), key, F.col("split")),
            violations(rows, 30, "held_out", F.col("document_id").isin(*held_out), key, F.col("document_id")),
            violations(rows, 40, "run", is_blank(F.col("deblur_run")), key),
            violations(rows, 50, "images", ~F.coalesce((F.size("image") == 2) & F.forall("image", lambda p: p.startswith("/")), F.lit(False)), key),
            violations(rows, 60, "turns", ~F.coalesce((F.size("conversations") == 2) & (turn(0, "from") == "human") & (turn(1, "from") == "gpt"), F.lit(False)), key),
            violations(rows, 70, "prompt", ~F.coalesce(turn(0, "value").startswith(template), F.lit(False)), key),
            *([violations(rows, 71, "whole_prompt", ~turn(0, "value").eqNullSafe(F.col("prompt")), key)] if "prompt" in rows.columns else []),
            *([violations(rows, 75, "sources", ~F.array_sort(F.map_entries("source_hashes")).eqNullSafe(F.array_sort(F.map_entries("known_hashes"))), key)] if {"source_hashes", "known_hashes"} <= set(rows.columns) else []),
            violations(rows, 80, "answer", is_blank(turn(1, "value")), key),
            determines(rows, 90, "document_in_one_split", "document_id", "split"),
        ]
    )


def reference_guards(pairs: DataFrame) -> DataFrame:
    """Rules of clear references joined to samples: rendered exactly, body kept, nothing
    changed outside stamps, and the same crops, hashes and sizes on both sides."""
    key = F.col("id")
    same = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    return union_all(
        [
            violations(pairs, 10, "exact_render", ~F.coalesce("exact_render", F.lit(False)), key),
            violations(pairs, 20, "body_preserved", ~F.coalesce("body_preserved", F.lit(False)), key),
            violations(pairs, 30, "changed_outside_stamps", F.coalesce("pixels_changed_outside", F.lit(1)) != 0, key),
            violations(pairs, 40, "crop", same("crop_box", "reference_crop_box"), key),
            violations(pairs, 50, "pdf_hash", same("pdf_sha256", "reference_pdf_sha256"), key),
            violations(pairs, 60, "gt_hash", same("gt_sha256", "reference_gt_sha256"), key),
            violations(pairs, 70, "size", same("page_size", "reference_page_size"), key),
        ]
    )


def render_guards(samples: DataFrame, records: DataFrame, incomplete: bool = False) -> DataFrame:
    """What keeps records (id, stage, role, out_sha256, status, lines array<struct<line_id,
    text, status>>) from being laid out for samples (id, role, out_sha256)."""
    known = samples.select("id", F.col("role").alias("_role"), F.col("out_sha256").alias("_sha")).distinct()
    both = records.join(known, "id")
    stage = records.select(F.lit("all").alias("all"), "stage")
    parts = [
        unmatched(samples, records, "id", 10),
        duplicates(records, 20, "unique:id", ["id"]),
        violations(records, 30, "stage", ~F.coalesce(F.col("stage").isin("ocr", "recovery"), F.lit(False)), F.col("id"), F.col("stage")),
        determines(stage, 40, "one_stage", "all", "stage"),
        violations(both, 50, "role", ~F.col("role").eqNullSafe(F.col("_role")), F.col("id"), F.col("_role")),
        violations(both, 60, "image", ~F.col("out_sha256").eqNullSafe(F.col("_sha")), F.col("id")),
    ]
    if not incomplete:
        parts.append(violations(records, 70, "incomplete", (F.col("status") == "error") | F.exists("lines", lambda x: (x["status"] == "error") | is_blank(x["text"])), F.col("id")))
    return union_all(parts)


# ---------------------------------------------------------------- keys and masks


def stage_key(settings: Mapping[str, Any], models: Mapping[str, str], code: Mapping[str, str], sample: Mapping[str, Any]) -> str:
    """The key under which a stage's result for a sample can be reused: everything that
    could change it."""
    return fingerprint_of({"settings": dict(settings), "models": dict(models), "code": dict(code), "sample": dict(sample)})


def supervised_mask(tokens: Column, prompt_tokens: Column, ignored: int = -100) -> Column:
    """Targets of an example: its tokens, those of the prompt replaced by `ignored`."""
    return F.transform(tokens, lambda t, i: F.when(i < prompt_tokens, F.lit(ignored)).otherwise(t))
