"""Splitting oversized items at natural boundaries, by byte ranges.

Items lie in files: giant text files as they are, or the oversized texts of a table, staged
back to back in the scratch folder. Work is dealt out in byte ranges, so that no worker
needs a whole file or text. A worker reads its range with a halo on both sides. Every range
has an anchor, the best boundary near its start; a worker finds its own anchor and the next
one from the same characters as its neighbour does, and cuts what lies between. What comes
out is a boundary table without any text: one row a piece. It is stitched by prefix sums of
the ranges' pieces and characters, which give each piece its number and its place in the
item, and texts are emitted at last by their byte offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.text import ctc_steps, one_line, strip_blanks
from quire.operators.compact import open_folder
from quire.operators.running import running_totals
from quire.session import new_scratch, settle

#: Bytes of a range of a large file; of a range of a staged text, so that longer texts are
#: shared out; and of the window behind a range's start in which its anchor lies.
RANGE, TEXT_RANGE = 65_536, 4_096
WINDOW = 1_024
#: Characters that boundaries may look back to.
LOOK = 64
#: Bytes that are read at once, of a task, and of a staged file, about.
BUFFER, TASK_BYTES, FILE_BYTES = 1 << 20, 32 << 20, 64 << 20
#: Ranges of an item whose counts are summed by one task.
RANGES_A_BIN = 4_096

#: Places where a text breaks, best first; the cut is behind the match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraph
    re.compile(r"(?<![A-Z][a-z])(?<!\b[A-Za-z])(?<!\b(?:cf|eg|ca|vs|no))(?<!\b(?:vol|fig))(?<!approx)[.!?][\"'”’)\]]*\s+"),  # sentence
    re.compile(r"\n\s*"),  # line
    re.compile(r"[;:,)\]—–]\s+"),  # clause
    re.compile(r"\s+"),  # word
    re.compile(r"(?<=\w)[-‐/]"),  # part of a word
]


def best_boundary(text: str, low: int, high: int, latest: bool = True) -> tuple[int, int]:
    """(offset, rank) of the best boundary with low < offset <= high: of the best kind that
    occurs there the latest one, or the first. Without any, `high` (or `low` + 1 when the
    first is asked for) and the rank behind all kinds."""
    for rank, kind in enumerate(BOUNDARIES):
        found = None
        for m in kind.finditer(text, max(0, low - LOOK), min(len(text), high + LOOK)):
            if low < m.end() <= high:
                found = m.end()
                if not latest:
                    break
            elif m.end() > high:
                break
        if found is not None:
            return found, rank
    return (high if latest else low + 1), len(BOUNDARIES)


def overlap_start(text: str, end: int, overlap: int, floor: int) -> int:
    """Where the piece after `end` starts: at the first start of a sentence, else of a word,
    among the last `overlap` characters, and beyond `floor`; `end` if there is none."""
    low = max(end - overlap, floor + 1)
    for kind in (BOUNDARIES[1], BOUNDARIES[4]):
        for m in kind.finditer(text, max(0, low - 1), end):
            if low <= m.end() < end:
                return m.end()
    return end


def cut_between(text: str, start: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, rank of the cut) that cover text[start:stop], each of at most
    `limit` characters, neighbours overlapping by at most `overlap`. A cut is sought in
    the last half of what a piece may hold, then in all of it."""
    out = []
    at = start
    covered = start
    while stop - at > limit:
        low = max(at + limit // 2, covered)
        end, rank = best_boundary(text, low, at + limit)
        if rank == len(BOUNDARIES) and low > covered:
            end, rank = best_boundary(text, covered, at + limit)
        out.append((at, end, rank))
        covered = end
        at = overlap_start(text, end, overlap, at)
        if at + limit <= covered:
            at = covered
    out.append((at, stop, 0))
    return out


# ---------------------------------------------------------------- ranges


class Slice:
    """Bytes of an item as text, with places told both ways. Characters cut at the ends of
    the slice are left out, unless the item itself starts or ends there; bytes that aren't
    UTF-8 are characters of their own."""

    def __init__(self, data: bytes, base: int, length: int) -> None:
        start, stop = 0, len(data)
        if base:
            while start < min(3, stop) and data[start] & 0xC0 == 0x80:
                start += 1
        if base + stop < length:
            for back in (1, 2, 3):
                byte = data[stop - back] if back <= stop - start else 0
                if byte >= 0xC0:
                    stop -= back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
                    break
                if byte < 0x80:
                    break
        part = data[start:stop]
        self.base, self.text, self.at = base + start, part.decode("utf-8", "surrogateescape"), None
        if len(self.text) < len(part):
            firsts = np.flatnonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80)
            if len(firsts) != len(self.text):
                firsts = np.cumsum([0] + [len(c.encode("utf-8", "surrogateescape")) for c in self.text])[:-1]
            self.at = [*firsts.tolist(), len(part)]

    def byte(self, char: int) -> int:
        return self.base + (char if self.at is None else self.at[char])

    def char(self, byte: int) -> int:
        """The first character at or behind a byte of the item."""
        byte -= self.base
        return max(0, min(byte, len(self.text))) if self.at is None else min(bisect_left(self.at, byte), len(self.text))


def anchor(part: Slice, at: int, length: int) -> int:
    """The best boundary in the window behind range start `at`, as a character of the slice;
    the item's start and end for the ends."""
    if at <= 0:
        return 0
    if at >= length:
        return len(part.text)
    low, high = part.char(at), part.char(min(at + WINDOW, length))
    begin = max(0, low - LOOK)
    here = part.text[begin:high]  # the same characters for both neighbours
    return begin + best_boundary(here, low - begin, len(here))[0]


def halo(overlap: int) -> int:
    """Bytes that a range is read with on either side: its anchors' windows, and what the
    overlap and the boundaries look back to, of up to four bytes a character."""
    return WINDOW + 4 * (2 * LOOK + overlap) + 16


def cut_words(text: str, start: int, stop: int, steps: int, per: float, room: float) -> list[tuple[int, int, int]]:
    """Pieces (start, end, rank) of text[start:stop] between words, each within `steps` steps
    and, at `per` pixels a character, less wide than `room` (0: any). The next piece repeats
    the last word where it still makes way; a word that is too long is cut between
    characters (the last rank)."""

    def fits(a: int, b: int) -> bool:
        return _steps(text[a:b]) <= steps and (not room or (b - a) * per <= max(room - 1, 1))

    words = [m.span() for m in re.compile(r"\S+").finditer(text, start, stop)]
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(words):
        a, j = words[i][0], i
        while j < len(words) and fits(a, words[j][1]):
            j += 1
        if j == i:  # one word beyond the capacity
            a, end = words[i]
            while a < end:
                b = a + 1
                while b < end and fits(a, b + 1):
                    b += 1
                out.append((a, b, len(BOUNDARIES) if b < end else 4))
                a = b
            i += 1
            continue
        out.append((a, words[j - 1][1], 4 if j < len(words) else 0))
        if j == len(words):
            break
        # Repeat a word if the piece that starts with it gets beyond this one.
        i = j - 1 if j - 1 > i and fits(words[j - 1][0], words[j][1]) else j
    return out


def _steps(text: str) -> int:
    return len(text) + sum(a == b for a, b in zip(text, text[1:]))


class Reader:
    """Byte ranges of files through one buffer, so that ranges in the order of their place
    are read in sequence and none is larger in memory than the buffer and its halo."""

    def __init__(self) -> None:
        self.path, self.base, self.data = "", 0, b""

    def read(self, path: str, start: int, stop: int) -> bytes:
        if path != self.path or start < self.base or stop > self.base + len(self.data):
            system, name = open_folder(path)
            with system.open_input_file(name) as f:
                f.seek(start)
                self.path, self.base, self.data = path, start, f.read(max(BUFFER, stop - start))
        return self.data[start - self.base : stop - self.base]


#: An item in a file: where it starts there, its bytes; `per` and `room` only of crops.
PLACE = ["path", "offset", "n_bytes", "per", "room"]
BOUNDARY = [("chars", T.LongType()), ("before", T.IntegerType()), ("parts", T.IntegerType()), ("from_byte", T.LongType()), ("to_byte", T.LongType()), ("from_char", T.IntegerType()), ("to_char", T.IntegerType()), ("cut_rank", T.IntegerType())]


def boundaries(items: DataFrame, limit: int, overlap: int, span: int, words: bool = False) -> DataFrame:
    """The boundary table of `items` (any columns besides PLACE), kept in the scratch folder:
    a row a piece, with the item's columns, the range (`at`), the range's characters between
    its anchors (`chars`), the parts a piece counts as and how many come before it in its
    range, its bytes in the item, and its characters from the range's anchor.

    With `words`, `limit` is in steps and pieces are cut between words (cut_words), else in
    characters and at the best boundaries (cut_between). Items without bytes have no row.
    """
    spark = items.sparkSession
    if span <= 2 * WINDOW:
        raise ValueError(f"a range needs more than {2 * WINDOW} bytes")
    total = items.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = items.filter("n_bytes > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(span).cast("bigint"))))
    ranges = ranges.withColumn("_place", F.col("offset") + F.col("at")).repartitionByRange(tasks, "path", "_place").sortWithinPartitions("path", "_place").drop("_place")
    schema = T.StructType([*ranges.schema, *(T.StructField(n, t) for n, t in BOUNDARY)])
    arrow = to_arrow_schema(schema)
    side = halo(overlap)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            out: list[tuple] = []
            for i, (path, offset, length, per, room, at) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*PLACE, "at"]))):
                base, stop = max(0, at - side), min(length, at + span + side)
                part = Slice(reader.read(path, offset + base, offset + stop), base, length)
                first, last = anchor(part, at, length), anchor(part, at + span, length)
                if last <= first:
                    continue
                if words:
                    found = cut_words(part.text, first, last, limit, per or 0.0, room or 0.0)
                else:
                    begin = overlap_start(part.text, first, overlap, max(-1, first - overlap - 1)) if at else first
                    found = cut_between(part.text, begin, last, limit, overlap)
                before = 0
                for a, b, rank in found:
                    parts = max(1, int(-(-((b - a) * per + 1) // room))) if per and room else 1
                    out.append((i, last - first, before, parts, part.byte(a), part.byte(b), a - first, b - first, rank))
                    before += parts
            cols = list(zip(*out)) or [()] * (len(BOUNDARY) + 1)
            kept = batch.take(pa.array(cols[0], pa.int64()))
            made = [pa.array(c, arrow.field(n).type) for (n, _), c in zip(BOUNDARY, cols[1:])]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], schema=pa.schema([*kept.schema, *(arrow.field(n) for n, _ in BOUNDARY)]))

    return settle(ranges.mapInArrow(detect, schema), "boundaries")


def stitch(found: DataFrame, span: int) -> DataFrame:
    """The boundary table with each piece's number and place in its item: piece_no, n_pieces,
    start and end in characters. Only counts of ranges are summed, in bins, so that an item
    of very many ranges is summed by many tasks; no text is moved."""
    item = ["path", "offset"]
    counts = found.groupBy(*item, "at").agg(F.sum("parts").alias("_n"), F.max("chars").alias("_c")).withColumn("_bin", F.floor(F.col("at") / F.lit(span * RANGES_A_BIN)))
    sums = running_totals(counts, {"_n_to": "_n", "_c_to": "_c"}, "_bin", ["at"], item)
    sums = sums.select(*item, "at", (F.col("_n_to") - F.col("_n")).alias("_n_from"), (F.col("_c_to") - F.col("_c")).alias("_c_from"))
    whole = counts.groupBy(*item).agg(F.sum("_n").alias("n_pieces"))
    pieces = found.join(sums, [*item, "at"]).join(whole, item)
    numbers = {"piece_no": F.col("_n_from") + F.col("before"), "start": F.col("_c_from") + F.col("from_char"), "end": F.col("_c_from") + F.col("to_char")}
    return pieces.withColumns(numbers).drop("_n_from", "_c_from", "chars", "before", "from_char", "to_char", "at")


def emit(pieces: DataFrame, out: str = "piece") -> DataFrame:
    """Add the texts of pieces, read by their byte offsets in the order of their place."""
    rows = pieces.sortWithinPartitions("path", "offset", "from_byte")
    schema = T.StructType([*rows.schema, T.StructField(out, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            places = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "offset", "from_byte", "to_byte")))
            texts = [reader.read(path, offset + a, offset + b).decode("utf-8", "replace") for path, offset, a, b in places]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return rows.mapInArrow(read, schema)


def stage_texts(items: DataFrame, text: str) -> DataFrame:
    """Write texts back to back to files in the scratch folder; `items` without the text and
    with where it lies (path, offset, n_bytes). A task that runs again writes files of new
    names; only those that the returned table names count."""
    folder = new_scratch(items.sparkSession, "texts")
    kept = [f for f in items.schema if f.name != text]
    schema = T.StructType([*kept, T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                paths, starts, sizes = [], [], []
                for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    data = (value or "").encode("utf-8", "surrogatepass")
                    if stream is None or at >= FILE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, at = f"{uuid.uuid4().hex}.txt", 0
                        stream = system.open_output_stream(f"{base}/{name}")
                    stream.write(data)
                    paths.append(f"{folder}/{name}")
                    starts.append(at)
                    sizes.append(len(data))
                    at += len(data)
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=schema.names)
        finally:
            if stream is not None:
                stream.close()

    return settle(items.mapInArrow(write, schema), "staged")


def split_texts(items: DataFrame, key: str, text: str, limit: int, overlap: int, span: int = TEXT_RANGE, texts: bool = True) -> DataFrame:
    """Pieces of texts: (key, piece_no, n_pieces, start, end, cut_rank, piece).

    `text` is taken without blanks at its ends; offsets count code points from there. A
    text within the limit is one piece; null and blank texts are one piece of length 0.
    cut_rank tells what kind of boundary ends the piece (0 best or the end; the highest:
    none was near). Repeated keys are separate items. Without `texts` the pieces' texts
    aren't read, and `piece` is left out.
    """
    t = items.select(F.col(key).alias("_key"), F.coalesce(strip_blanks(F.col(text)), F.lit("")).alias("_text")).withColumn("_length", F.length("_text").cast("bigint"))
    zero = F.lit(0).cast("bigint")
    whole = t.filter(F.col("_length") <= limit).select("_key", zero.alias("piece_no"), F.lit(1).cast("bigint").alias("n_pieces"), zero.alias("start"), F.col("_length").alias("end"), F.lit(0).alias("cut_rank"), F.col("_text").alias("piece"))
    none = F.lit(None).cast("double")
    staged = stage_texts(t.filter(F.col("_length") > limit).select("_key", "_text", none.alias("per"), none.alias("room")), "_text")
    pieces = stitch(boundaries(staged, limit, overlap, span), span)
    columns = ["_key", "piece_no", "n_pieces", "start", "end", "cut_rank", *(["piece"] if texts else [])]
    cut = (emit(pieces) if texts else pieces).select(*columns)
    return whole.select(*columns).unionByName(cut).withColumnRenamed("_key", key)


def split_files(spark: SparkSession, pattern: str, limit: int, overlap: int, span: int = RANGE) -> DataFrame:
    """Pieces of UTF-8 text files by byte offset: (path, piece_no, n_pieces, start, end,
    from_byte, to_byte, cut_rank); start and end count characters, `limit` and `overlap` too.

    Only file lengths are listed; workers seek to their ranges. Empty files have no pieces.
    Bytes that aren't UTF-8 count as a character each, and come out as they are.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("n_bytes"))
    none = F.lit(None).cast("double")
    items = files.select("path", F.lit(0).cast("bigint").alias("offset"), "n_bytes", none.alias("per"), none.alias("room"))
    pieces = stitch(boundaries(items, limit, overlap, span), span)
    return pieces.select("path", "piece_no", "n_pieces", "start", "end", "from_byte", "to_byte", "cut_rank")


# ---------------------------------------------------------------- crops

CROP_STEPS = 40
WIDEST = 20  # widths of a height: 960 px at 48


def sound_box(box: Column) -> Column:
    """Four numbers with x0 < x1 and y0 < y1; null counts as false."""
    whole = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull())
    return F.coalesce(whole & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3))), F.lit(False))


def split_crops(crops: DataFrame, key: str = "image", text: str = "text", box: str = "box", steps: int = CROP_STEPS, widest: int = WIDEST, span: int = RANGE, texts: bool = True) -> DataFrame:
    """Pieces of crops: (key, piece_no, n_pieces, piece, box, steps), from distinct rows.

    Texts are taken in ASCII form on one line. Crops within the capacity are one piece.
    Others are cut between words by byte ranges like all items, the next piece repeating
    the last word where it still makes way, and a word that is too long between characters.
    Characters share the box evenly. A piece that stays too wide for its characters is cut
    alone, and only its first part keeps the text; so is a crop without text. Null or blank
    texts have no steps and a box that isn't sound has no width; such a box comes out as
    null. Rows that share a key but differ are cut each on its own. Without `texts` the
    columns piece and steps are left out.
    """
    t = crops.select(F.col(key).alias("_key"), F.coalesce(one_line(F.col(text)), F.lit("")).alias("_text"), F.when(sound_box(F.col(box)), F.col(box).cast("array<int>")).alias("_box")).distinct()
    x0, y0, x1, y1 = (F.get("_box", F.lit(i)) for i in range(4))
    room = (widest * (y1 - y0)).cast("double")
    width, n = (x1 - x0).cast("double"), F.length("_text")
    t = t.withColumns({"_over": F.coalesce(width > room, F.lit(False)) | (ctc_steps(F.col("_text")) > steps), "room": room, "per": F.when(n > 0, width / n)})
    one = F.lit(1).cast("bigint")
    plain = t.filter(~F.col("_over") | (F.col("_text") == "")).select("_key", F.col("_text").alias("piece"), F.col("_box").alias("box"), F.when(F.col("_over"), F.ceil(width / room)).otherwise(one).alias("n_pieces"))
    plain = plain.select("_key", "piece", "box", "n_pieces", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)).alias("piece_no")).withColumns({"_cell": F.col("piece_no"), "_cells": F.col("n_pieces")})
    staged = stage_texts(t.filter(F.col("_over") & (F.col("_text") != "")).select("_key", "_text", "_box", "per", "room"), "_text")
    pieces = stitch(boundaries(staged, steps, 0, span, words=True), span)
    pieces = emit(pieces) if texts else pieces.withColumn("piece", F.lit(""))
    left = F.least(x0 + F.round(F.col("start") * F.col("per")).cast("int"), x1 - 1)
    right = F.greatest(left + 1, F.least(x1, x0 + F.round(F.col("end") * F.col("per")).cast("int")))
    share = F.when(F.col("_box").isNotNull(), F.array(left, y0, right, y1))
    cut = pieces.select("_key", "piece", share.alias("box"), "n_pieces", F.col("parts").alias("_cells"), F.col("piece_no").alias("_first"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_cell"))
    cut = cut.withColumn("piece_no", F.col("_first") + F.col("_cell")).drop("_first")
    rows = plain.unionByName(cut)
    a, b = F.get("box", F.lit(0)), F.get("box", F.lit(2))
    edge = lambda k: (a + F.floor((b - a) * k / F.col("_cells"))).cast("int")
    cell = F.when(F.col("box").isNotNull(), F.array(edge(F.col("_cell")), F.get("box", F.lit(1)), edge(F.col("_cell") + 1), F.get("box", F.lit(3))))
    rows = rows.withColumns({"box": cell, "piece": F.when(F.col("_cell") == 0, F.col("piece")).otherwise(F.lit(""))})
    columns = [F.col("_key").alias(key), "piece_no", "n_pieces", "box"]
    return rows.select(*columns, "piece", ctc_steps(F.col("piece")).alias("steps")) if texts else rows.select(*columns)


# ---------------------------------------------------------------- labels


def current_labels(labels: DataFrame) -> DataFrame:
    """(id, text) of the newest version of each id, if verified. Versions of the same time
    are settled by loaded_at, then by being verified, then by the text."""
    order = F.struct("written_at", "loaded_at", F.coalesce("verified", F.lit(False)).alias("verified"), "text")
    newest = labels.groupBy("id").agg(F.max(order).alias("v"))
    return newest.filter("v.verified").select("id", F.col("v.text").alias("text"))
