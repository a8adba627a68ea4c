"""Training phrases packed from words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.functions.text import ascii_form, ctc_steps, printable_ascii

TARGET_LENGTH, CAPACITY = 32, 40

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_ASCII_TABLE = {**dict.fromkeys(map(ord, tx.SINGLE_QUOTES), "'"), **dict.fromkeys(map(ord, tx.DOUBLE_QUOTES), '"'), **dict.fromkeys(map(ord, tx.DASHES), "-"), ord(tx.NO_BREAK_SPACE): " ", **{ord(k): v for k, v in tx.WIDE_REPLACEMENTS}}

# Marks of lines that aren't text of the page.
WATERMARKS = ("document shared on", "downloaded by")
# End of fixed values.


def is_watermark(line: Column, phrases: tuple[str, ...] = WATERMARKS) -> Column:
    """True where a line, in lower case, holds one of the phrases."""
    low = F.lower(line)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def in_stamp(x: Column, y: Column, stamps: Column) -> Column:
    """True where a point lies in any of the rectangles array<struct<x0,y0,x1,y1>>."""
    return F.coalesce(F.exists(stamps, lambda s: x.between(s["x0"], s["x1"]) & y.between(s["y0"], s["y1"])), F.lit(False))


def exclusion(word: Column, stamped: Column | None = None, outside: Column | None = None) -> Column:
    """Why a word can't be trained on, the first reason that holds, or null: it lies in a
    stamp, has a character without an ASCII form, lies outside the crop, or is too long."""
    plain = ascii_form(word)
    reason = F.when(F.coalesce(stamped, F.lit(False)) if stamped is not None else F.lit(False), "watermark_geometry")
    reason = reason.when(~printable_ascii(plain), "unsupported_character")
    if outside is not None:
        reason = reason.when(F.coalesce(outside, F.lit(True)), "outside_or_partial_word")
    return reason.when(ctc_steps(plain) > CAPACITY, "word_exceeds_ctc_capacity")


def words_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, word_no, word): words of a text by line, split at blanks."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    found = F.regexp_extract_all("_line", F.lit(r"(\S+)"), 1)
    return lines.select(*keys, "line_no", F.posexplode(found).alias("word_no", "word"))


def steps_of(text: str) -> int:
    return len(text) + sum(map(str.__eq__, text, text[1:]))


def pack(words: list[str]) -> list[str]:
    """Phrases of a line's words in order: a word joins the phrase before it unless the
    phrase would exceed TARGET_LENGTH characters or CAPACITY steps; a word that can't be
    trained on ends the phrase and is never bridged. One word alone may exceed the target
    length. Words are taken in ASCII form."""
    out: list[str] = []
    held = ""
    for word in words:
        plain = word if word.isascii() else word.translate(_ASCII_TABLE)
        if not (plain.isascii() and plain.isprintable()) or steps_of(plain) > CAPACITY:
            if held:
                out.append(held)
            held = ""
            continue
        longer = f"{held} {plain}" if held else plain
        if held and (len(longer) > TARGET_LENGTH or steps_of(longer) > CAPACITY):
            out.append(held)
            longer = plain
        held = longer
    if held:
        out.append(held)
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _packed(lines: pa.Array) -> pa.Array:
    return pa.array([None if x is None else pack(_WORD.findall(x)) for x in lines.to_pylist()], pa.list_(pa.string()))


def phrases(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, phrase_no, phrase) for the lines of a text column. Packing depends on
    the word before, and a fold over growing arrays costs the square of a line's length,
    so a line is packed in one pass in an Arrow batch."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    return lines.select(*keys, "line_no", F.posexplode(_packed("_line")).alias("phrase_no", "phrase"))


# ---------------------------------------------------------------- words with places

PAGE = ["document_number", "web_page"]


def page_words(words: DataFrame, references: DataFrame) -> DataFrame:
    """Words of pages that have a reference, with the reason why a word can't be trained on.

    `words` has document_number, web_page, block, line, word_no, text and its box (x0, y0, x1,
    y1, downwards); `references` have the page's pdf_height, its stamps (array of struct x0,
    y0, x1, y1, upwards, as such documents count) and its crop (struct of the same). Document
    numbers are compared as strings. The reason of a watermark's line goes before all others;
    then a word is refused if its middle is in a stamp, if it has no ASCII form, if it isn't
    wholly in the crop, or if it is too long. Words without text or box are refused too.
    """
    page = [F.col("document_number").cast("string").alias("document_number"), "web_page"]
    known = references.select(*page, "pdf_height", "stamps", "crop")
    rows = words.select(*page, "block", "line", "word_no", "text", "x0", "y0", "x1", "y1").join(known, PAGE)
    said = rows.groupBy(*PAGE, "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("_line"))
    marked = said.filter(is_watermark(F.col("_line"))).select(*PAGE, "block", "line", F.lit(True).alias("_marked"))
    stamped = in_stamp((F.col("x0") + F.col("x1")) / 2, F.col("pdf_height") - (F.col("y0") + F.col("y1")) / 2, F.col("stamps"))
    inside = (F.col("x0") >= F.col("crop.x0")) & (F.col("y0") >= F.col("crop.y0")) & (F.col("x1") <= F.col("crop.x1")) & (F.col("y1") <= F.col("crop.y1"))
    rows = rows.join(marked, [*PAGE, "block", "line"], "left")
    reason = F.when(F.coalesce("_marked", F.lit(False)), "watermark_line").otherwise(exclusion(F.coalesce("text", F.lit("")), stamped, ~F.coalesce(inside, F.lit(False))))
    return rows.select(*PAGE, "block", "line", "word_no", "text", "x0", "y0", "x1", "y1", reason.alias("reason"))


def word_audit(words: DataFrame) -> DataFrame:
    """Of page_words the rows to look at: refused ones, and kept ones whose text changes."""
    changed = F.when(ascii_form(F.col("text")) != F.col("text"), "normalized_punctuation_or_ligature")
    rows = words.withColumn("reason", F.coalesce("reason", changed)).filter("reason is not null")
    return rows.select(*PAGE, "reason", ascii_form(F.col("text")).alias("text"), F.col("text").alias("original"))


SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def pack_places(words: list[str | None]) -> list[tuple[str, int, int]]:
    """pack() with the places (first, last) of each phrase's words; None ends a phrase."""
    out: list[tuple[str, int, int]] = []
    held: tuple[str, int, int] | None = None
    for i, word in enumerate(words):
        joined = f"{held[0]} {word}" if held and word is not None else None
        if joined is not None and len(joined) <= TARGET_LENGTH and steps_of(joined) <= CAPACITY:
            held = (joined, held[1], i)
            continue
        if held:
            out.append(held)
        held = (word, i, i) if word is not None else None
    return [*out, held] if held else out


@F.arrow_udf(SPANS)
def _placed(lines: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("text", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    return pa.array([[dict(zip(("text", "first", "last"), p)) for p in pack_places(ws or [])] for ws in lines.to_pylist()], kind)


def supervised_phrases(words: DataFrame) -> DataFrame:
    """Phrases of page_words: (document_number, web_page, phrase_no, text, box, n_words), each
    with the union of its words' boxes, numbered down the page and from left to right."""
    word = F.struct("word_no", F.when(F.col("reason").isNull(), ascii_form(F.col("text"))).alias("t"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    lines = words.groupBy(*PAGE, "block", "line").agg(F.array_sort(F.collect_list(word)).alias("w"))
    rows = lines.select(*PAGE, "block", "line", "w", F.posexplode(_placed(F.transform("w", lambda x: x["t"]))).alias("_k", "p"))
    mine = F.slice("w", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1)
    side = lambda f, c: f(F.transform(mine, lambda x: x[c]))
    box = F.array(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))
    rows = rows.select(*PAGE, "block", "line", "_k", F.col("p.text").alias("text"), box.alias("box"), F.size(mine).alias("n_words"))
    order = Window.partitionBy(*PAGE).orderBy(F.col("box")[1], F.col("box")[0], "block", "line", "_k")
    return rows.select(*PAGE, (F.row_number().over(order) - 1).alias("phrase_no"), "text", "box", "n_words")
