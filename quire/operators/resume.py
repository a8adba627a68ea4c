"""Incremental work: fingerprints, latest attempts, what can be reused and what is pending."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, characters as they are, nulls kept; NaN and infinities refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint_of(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest()


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        if value and all(isinstance(x, tuple) and len(x) == 2 for x in value):
            return {str(k): _plain(v) for k, v in value}
        return [_plain(x) for x in value]
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("numbers must be finite")
    return value


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct of columns; one function makes all of them,
    so that fingerprints are stable. Maps become objects, null fields stay as nulls."""

    @F.arrow_udf(T.StringType())
    def digest(rows: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(_plain(r)) for r in rows.to_pylist()], pa.string())

    return digest(F.struct(*cols))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last attempt of each key, failures included. `order` must break ties; the whole
    row is taken by one aggregate, so a key with very many attempts is combined early."""
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def reusable(attempts: DataFrame, keys: list[str], order: list[Column], statuses: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Latest attempts whose status allows reuse. Stages differ in the keys (an id, a block,
    a fingerprint) and in whether `review` counts."""
    return latest(attempts, keys, order).filter(F.col("status").isin(*statuses))


def pending(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Jobs without a reusable result."""
    return jobs.join(done.select(*on).distinct(), on, "left_anti")


def finished(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Jobs with a reusable result."""
    return jobs.join(done.select(*on).distinct(), on, "left_semi")


def cache_valid(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Ids of cached pages (id, stage, schema_version, status, assets map<path,sha256>) of
    which every asset is present with the same hash (assets: path, sha256)."""
    sound = pages.filter(F.col("schema_version").isin(2, 3) & (F.col("stage") == "ocr") & F.col("status").isin("ok", "review") & (F.size("assets") > 0))
    named = sound.select("id", F.explode("assets").alias("path", "_want"))
    joined = named.join(assets.select("path", "sha256"), "path", "left")
    return joined.groupBy("id").agg(F.bool_and(F.coalesce(F.col("_want") == F.col("sha256"), F.lit(False))).alias("_ok")).filter("_ok").select("id")


def merge_history(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New results plus the earlier ones that weren't visited again."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def exit_status(results: DataFrame) -> int:
    """1 if any result failed, else 0."""
    return int(not results.filter(F.col("status") == "error").isEmpty())


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first `n` rows of an order that breaks ties; `n` is 1 at least. Each task keeps
    its own first rows, so no more than `n` of each are brought together."""
    return df.orderBy(*order).limit(bounded("n", n, 1))


def bounded(name: str, value: int, least: int, most: int | None = None) -> int:
    """An argument that must be a whole number within bounds."""
    if type(value) is not int or value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be a whole number of at least {least}" + ("" if most is None else f" and at most {most}"))
    return value


def set_fingerprint(df: DataFrame, keys: list[str], *members: Column) -> DataFrame:
    """(keys, members, fingerprint): a fingerprint of the set of different members of each key,
    from the sum and the number of their hashes, so that nothing is collected or sorted."""
    said = F.concat_ws("|", *[F.coalesce(m.cast("string"), F.lit("~")) for m in members])
    rows = df.select(*keys, said.alias("_m")).distinct()
    number = F.conv(F.substring(F.sha2("_m", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum(number).alias("_s"))
    return found.select(*keys, "members", F.sha2(F.concat_ws(":", F.col("_s").cast("string"), F.col("members").cast("string")), 256).alias("fingerprint"))


def line_key(line: Column, images: Column, assets: Column, context: Column, settings: Column, model: Column, prompt: Column, lexicon: Column, code: Column) -> Column:
    """The key under which a line's selection can be used again: all that its result depends on."""
    parts = {"line": line, "image_hashes": images, "asset_hashes": assets, "context": context, "settings": settings, "model": model, "prompt": prompt, "lexicon": lexicon, "code": code}
    return fingerprint(*[c.alias(k) for k, c in parts.items()])


def block_key(region: Column, scale: Column, settings: Column, prompt: Column, code: Column) -> Column:
    """The same for a block of a page."""
    parts = {"region": region, "scale": scale, "settings": settings, "prompt": prompt, "code": code}
    return fingerprint(*[c.alias(k) for k, c in parts.items()])
