"""Names, flags, loops and strict replies."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases of an explanation instead of a transcription; device names.
EXPLANATIONS = ["i cannot", "i can't", "i am unable", "i'm unable", "as an ai", "the image is too", "the text is too blurred", "here is the transcription"]
DEVICES = r"\A(?:CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])\z"
# End of fixed values.


def review_flags(text: Column) -> Column:
    """Warnings about a transcription, in fixed order; none for null."""
    low = F.lower(text)
    said = F.lit(False)
    for phrase in EXPLANATIONS:
        said = said | F.contains(low, F.lit(phrase))
    flags = F.array(
        F.when(said, "possible_explanation"),
        F.when(F.contains(low, F.lit("[unclear]")), "unclear_spans"),
        F.when(F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")) > 20, "unexpected_language"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def safe_filename(name: Column) -> Column:
    """The name itself where it is one on every system, else one made from its hash."""
    plain = name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,100}\z") & ~name.rlike(r"[. ]\z")
    device = F.upper(F.split_part(name, F.lit("."), F.lit(1))).rlike(DEVICES)
    quoted = F.concat(F.lit('"'), _escaped(F.regexp_replace(name, r'(["\\])', r"\\$1")), F.lit('"'))
    return F.when(plain & ~device, name).otherwise(F.concat(F.lit("sample-"), F.substring(F.sha2(quoted, 256), 1, 16)))


def _escaped(text: Column) -> Column:
    """Control characters as JSON escapes them; texts without any aren't touched."""
    out = text
    for code in range(32):
        sign = chr(code)
        out = F.replace(out, F.lit(sign), F.lit(json.dumps(sign)[1:-1]))
    return F.when(text.rlike(r"[\x00-\x1f]"), out).otherwise(text)


def safe_crop_id(name: Column) -> Column:
    """True where an id can name a crop file, whatever its length."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]*\z"), F.lit(False))


def page_number(sample_id: Column, page: Column) -> Column:
    """The page where it is given, else the digits behind the first '_' of the id; null
    unless positive."""
    found = F.regexp_extract(sample_id, r"\A[^_]*_([0-9]+)", 1)
    number = F.coalesce(page.cast("bigint"), F.when(found != "", found.cast("bigint")))
    return F.when(number > 0, number)


def repeat_tail(words: Column) -> Column:
    """True where the last four cycles of some period of 12 to 128 words are the same."""

    def tail(w: Column) -> Column:
        n = F.size(w)
        top = F.greatest(F.least(F.lit(128), F.floor(n / 4).cast("int")), F.lit(12))

        def loops(p: Column) -> Column:
            # Most periods are ruled out by the last word alone.
            end = F.get(w, n - 1)
            ends = (end == F.get(w, n - 1 - p)) & (end == F.get(w, n - 1 - 2 * p)) & (end == F.get(w, n - 1 - 3 * p))
            last = F.slice(w, n - p + 1, p)
            return ends & F.forall(F.sequence(F.lit(2), F.lit(4)), lambda k: F.slice(w, n - k * p + 1, p) == last)

        return F.when(n >= 48, F.exists(F.sequence(F.lit(12), top), loops)).otherwise(F.lit(False))

    # Bound once: an expression inside a lambda is evaluated anew at every step.
    return F.coalesce(F.exists(F.array(words), tail), F.lit(False))


_KINDS = {"int": lambda v: isinstance(v, int) and not isinstance(v, bool), "str": lambda v: isinstance(v, str), "list": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}


def read_strict(raw: str | None, keys: Mapping[str, str]) -> str | None:
    """The canonical JSON of a reply that is one object with exactly these keys and kinds,
    a code fence around the whole reply aside; else null. Of a repeated key the last counts."""
    if raw is None:
        return None
    value = raw.strip()
    if value.startswith("```") and value.endswith("```") and len(value) >= 6:
        value = re.sub(r"\A```(?:json)?\s*", "", value)[:-3].strip()
    try:
        data = json.loads(value)
    except (ValueError, RecursionError):
        return None
    if not isinstance(data, dict) or data.keys() != set(keys) or not all(_KINDS[k](data[n]) for n, k in keys.items()):
        return None
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def strict_reply(raw: Column, keys: Mapping[str, str]) -> Column:
    """Struct(ok, value): see read_strict."""
    kind = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType())])

    @F.arrow_udf(kind)
    def read(texts: pa.Array) -> pa.Array:
        values = [read_strict(t, keys) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([v is not None for v in values]), pa.array(values, pa.string())], ["ok", "value"])

    return read(raw)


def prompt(template: str, blur: Column, out: Column) -> Column:
    """A template followed by the two readings as JSON, and nothing else of the record."""
    return F.concat(F.lit(template), F.lit("\n"), F.to_json(F.struct(blur.alias("blur_text"), out.alias("out_text")), {"ignoreNullFields": "false"}))
