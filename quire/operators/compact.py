"""Consolidation of millions of tiny record files into few well-sized ones.

Files come as rows (key, content); the session's split packing (maximum partition bytes
and file-open cost, set from the table's size) reads many of them into one task without
an exchange. Each task cuts its contents into records and writes them, in their bytes,
to staged packs; what it returns is a manifest: one small row a record with its 128-bit
identity and place. Only the manifest is exchanged, to find records that occur more than
once. Staged packs are coalesced, later copies left out, into files of the wanted size;
these are read back and verified record by record against the manifest, and only then
moved to where readers look, under names that a repeated move can't double. What failed or
repeated attempts left behind is deleted with the staged packs.

Staging needs a folder that every executor can write: the session's scratch folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.running import hash_bin, running_total
from quire.session import delete_path, discard, new_scratch, settle

#: Bytes of records in a staged pack, in a published one at most, and in what one task coalesces.
TARGET_BYTES = 768 * 1024
MOST_BYTES = 1024 * 1024
UNIT_BYTES = 8 * 1024 * 1024
#: Staged packs are compressed, and so are published ones: as plain records they have up to
#: MOST_BYTES, in the folder a sixth to a half of it, in a form that any reader of text knows.
STAGED, PUBLISHED = "zstd", "gzip"
#: Manifest rows that leave a task at once.
MANIFEST_ROWS = 20_000

MANIFEST = T.StructType(
    [
        T.StructField("file_key", T.LongType()), T.StructField("record_no", T.IntegerType()), T.StructField("identity", T.BinaryType()),
        T.StructField("n_bytes", T.IntegerType()), T.StructField("pack", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("line_hash", T.LongType()),
    ]
)


#: No digit of a number is rounded away.
_EXACT = Context(prec=100_000)


def _number(text: str) -> int | Number:
    """A JSON number such that equal values have equal results, whatever their notation."""
    value = Decimal(text).normalize(_EXACT)
    if not value.is_finite():
        return Number(f"\0{text}")
    exponent = value.as_tuple().exponent
    if 0 <= exponent < 400:
        return int(value)
    return Number(f"\0{value}")


class Number(str):
    """A number that isn't whole, marked by a first character that strings hardly have."""


def _tagged(value: object) -> object:
    """A value in which marked numbers and strings can't be the same."""
    if isinstance(value, dict):
        return sorted((k, _tagged(v)) for k, v in value.items())
    if isinstance(value, list):
        return [_tagged(v) for v in value]
    return (type(value).__name__, value)


def _refuse(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_float=_number, parse_int=lambda t: int(t) if len(t) < 400 else _number(t), parse_constant=_refuse)
_encoder = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


def canonical(line: str) -> bytes | None:
    """Identity of a record: the same for the same fields with the same values, numbers by
    value. None where the line isn't one whole JSON object."""
    try:
        value = _decoder.decode(line)
    except (ValueError, RecursionError, ArithmeticError):
        return None
    if not isinstance(value, dict):
        return None
    if "\\u0000" in line:  # a string might look like a marked number
        return xxhash.xxh3_128_digest(repr(_tagged(value)).encode("utf-8", "surrogatepass"))
    return xxhash.xxh3_128_digest(_encoder.encode(value).encode("utf-8", "surrogatepass"))


def records(content: str | None) -> Iterator[tuple[int, bytes, str]]:
    """(number, identity, text) of the whole records of a file. Byte-order marks, any line
    ends and blank lines are allowed; unfinished records and other values are none."""
    if not content:
        return
    for no, line in enumerate(content.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        line = line.strip("﻿ \t")
        if line and (identity := canonical(line)) is not None:
            yield no, identity, line


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it. Paths without a scheme are those of the
    machine; the scratch folder's always have one."""
    return pafs.FileSystem.from_uri(folder)


def packed_splits(spark: SparkSession, path: str, tasks: int | None = None, open_cost: int = 64 * 1024) -> DataFrame:
    """Read a Parquet folder with splits packed so that about `tasks` tasks share it: the
    partition size follows the folder's size, and opening a file costs little, so that
    small files are read together. The settings hold for a session of their own."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.files.openCostInBytes", str(open_cost))
    session.conf.set("spark.sql.files.maxPartitionBytes", str(min(128 << 20, max(1 << 20, size // tasks + open_cost))))
    return session.read.parquet(path)


def stage_packs(files: DataFrame, key: str, content: str, folder: str, target: int = TARGET_BYTES) -> DataFrame:
    """Write the records of `files` to packs in `folder` and return their manifest, a table
    in the scratch folder. Copies inside one pack are written once and kept in the
    manifest with the place of the first. No exchange takes place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        rows: list[tuple] = []
        lines: list[bytes] = []
        places: dict[bytes, tuple[int, int]] = {}
        size, name = 0, f"{uuid.uuid4().hex}.jsonl"

        def flush() -> None:
            nonlocal lines, places, size, name
            with system.open_output_stream(f"{base}/{name}", compression=STAGED) as packed:
                packed.write(b"".join(lines))
            lines, places, size, name = [], {}, 0, f"{uuid.uuid4().hex}.jsonl"

        def told() -> pa.RecordBatch:
            nonlocal rows
            cols = list(zip(*rows)) or [()] * len(MANIFEST)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=MANIFEST.names)

        for batch in batches:
            for file_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, identity, line in records(text):
                    if identity not in places:
                        data = line.encode("utf-8", "surrogatepass") + b"\n"
                        if size and size + len(data) > target:
                            flush()
                        places[identity] = (len(lines), line_number(data))
                        lines.append(data)
                        size += len(data)
                    at, number = places[identity]
                    rows.append((file_key, no, identity, len(lines[at]), name, at, number))
                    # A task of copies of one record writes little and still tells much.
                    if len(rows) >= MANIFEST_ROWS:
                        yield told()
        if lines:
            flush()
        if rows:
            yield told()

    return settle(files.select(key, content).mapInArrow(write, MANIFEST), "manifest")


def shared_records(manifest: DataFrame) -> DataFrame:
    """(identity, file_key) of the records that more than one file holds, kept in the scratch
    folder."""
    held = manifest.select("identity", "file_key").distinct()
    several = held.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("identity")
    return settle(held.join(several, "identity", "left_semi"), "shared")


def sharing_members(manifest: DataFrame) -> DataFrame:
    """(representative, file_key): each file that holds a record of several files, with the
    smallest key of that record's files. Linear in the files, whatever the number of copies."""
    held = shared_records(manifest)
    first = held.groupBy("identity").agg(F.min("file_key").alias("representative"))
    return held.join(first, "identity").select("representative", "file_key").distinct()


def sharing_pairs(manifest: DataFrame) -> DataFrame:
    """(asset_a, asset_b) with a < b: keys of files that hold a same record. Every pair is
    asked for, so a record in n files gives n(n-1)/2 rows; only files that share one are
    ever brought together, and a record of many files is joined by as many tasks as the
    skew join makes of it. sharing_members() says the same in n rows."""
    held = shared_records(manifest)
    a, b = held.withColumnRenamed("file_key", "asset_a"), held.withColumnRenamed("file_key", "asset_b")
    return a.join(b, "identity").filter("asset_a < asset_b").select("asset_a", "asset_b").distinct()


PACK = T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("pack", T.StringType()), ("n_records", T.LongType()), ("n_bytes", T.LongType()))])
READ = T.StructType([*PACK, T.StructField("stored_bytes", T.LongType()), T.StructField("line_hashes", T.ArrayType(T.LongType()))])


def _columns(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, schema)], names=schema.names)


def line_number(line: bytes) -> int:
    """63 bits of a hash of a record as it is written, its line end included; sums of them tell
    sets of records apart."""
    return xxhash.xxh3_64_intdigest(line) >> 1


def kept_records(manifest: DataFrame) -> DataFrame:
    """What is kept of each staged pack: (pack, places, n_records, bytes, hash_sum), one place
    for each different record, kept in the scratch folder."""
    spots = manifest.groupBy("identity").agg(F.min(F.struct("pack", "place", "n_bytes", "line_hash")).alias("keep")).select("keep.*")
    sums = [F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("bytes"), F.sum(F.col("line_hash").cast("decimal(38,0)")).alias("hash_sum")]
    return settle(spots.groupBy("pack").agg(F.collect_list("place").alias("places"), *sums), "kept")


def coalesce_packs(kept: DataFrame, staged: str, out: str, most: int = MOST_BYTES) -> DataFrame:
    """Join staged packs, as far as their records are kept, into files in `out` of at most
    `most` bytes of records; returns PACK rows of what the tasks wrote: the file's `name`
    there, and the name it is to have (`pack`), which follows from its place alone."""
    packs = kept.select("pack", "places", "bytes")
    # Units of packs: a running total of bytes inside hash bins, cut at an even size.
    total = packs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bins = max(1, int(total // (64 * UNIT_BYTES)))
    packs = packs.withColumn("_hash", F.xxhash64("pack")).withColumn("_bin", hash_bin(F.col("_hash"), bins))
    summed = running_total(packs, "bytes", "_bin", ["_hash", "pack"], "_sum")
    size = total / max(1, round(total / UNIT_BYTES)) or 1
    units = settle(summed.withColumn("unit", F.floor((F.col("_sum") - F.col("bytes") / 2) / size)), "units").select("unit", "pack", "places", F.col("bytes").cast("bigint"))

    def rewrite(rows: pa.Table) -> pa.Table:
        source, base = open_folder(staged)
        system, target = open_folder(out)
        system.create_dir(target, recursive=True)
        unit = rows["unit"][0].as_py()
        done: list[tuple] = []
        lines, held = [], 0
        whole = sum(rows["bytes"].to_pylist())
        even = whole / -(-whole // (0.95 * most))  # equal parts, each within `most`

        def flush() -> None:
            nonlocal lines, held
            name = f"{uuid.uuid4().hex}.jsonl.gz"
            with system.open_output_stream(f"{target}/{name}", compression=PUBLISHED) as packed:
                packed.write(b"".join(lines))
            done.append((name, f"pack-{unit:09d}-{len(done):04d}.jsonl.gz", len(lines), held))
            lines, held = [], 0

        for pack, places in sorted(zip(rows["pack"].to_pylist(), rows["places"].to_pylist())):
            with source.open_input_stream(f"{base}/{pack}", compression=STAGED) as stream:
                found = stream.read().split(b"\n")
            for p in sorted(places):
                data = found[p] + b"\n"
                if lines and (held >= even or held + len(data) > most):
                    flush()
                lines.append(data)
                held += len(data)
        if lines:
            flush()
        return _columns(done, PACK)

    return settle(units.groupBy("unit").applyInArrow(rewrite, PACK), "coalesced")


def read_back(packs: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """READ rows: what files of `packs` in `folder` hold when they are read again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with system.open_input_stream(f"{base}/{row[name]}", compression=PUBLISHED) as stream:
                    data = stream.read()
                found = data.splitlines(keepends=True)
                out.append((row["name"], row["pack"], len(found), len(data), system.get_file_info(f"{base}/{row[name]}").size, list(map(line_number, found))))
            yield from _columns(out, READ).to_batches()

    return packs.repartition(max(1, packs.sparkSession.sparkContext.defaultParallelism), "pack").mapInArrow(read, READ)


def verify(kept: DataFrame, read: DataFrame) -> None:
    """Raise unless the files read back hold each record that is kept exactly once, byte by
    byte as it was staged: the number of records, how many different ones a file has, and
    the sum of their hashes."""
    zero = F.lit(0).cast("decimal(38,0)")
    want = kept.agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("hash_sum").cast("decimal(38,0)")), zero).alias("s")).first()
    each = F.aggregate("line_hashes", zero, lambda a, x: (a + x).cast("decimal(38,0)"))
    got = read.agg(F.coalesce(F.sum(F.size("line_hashes")), F.lit(0)).alias("n"), F.coalesce(F.sum(each), zero).alias("s"), F.coalesce(F.sum(F.size(F.array_distinct("line_hashes"))), F.lit(0)).alias("d")).first()
    if (got["n"], got["s"]) != (want["n"], want["s"]) or got["d"] != got["n"]:
        raise RuntimeError(f"packs hold {got['n']} records, {got['d']} different ones in their files, the manifest {want['n']}; sums {got['s']} and {want['s']}")


def publish(packs: DataFrame, folder: str, out: str) -> None:
    """Move files from `folder` to `out`, each under its own name. A move that is run again
    finds its file there and does nothing."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = open_folder(folder)
        system, target = open_folder(out)
        system.create_dir(target, recursive=True)
        for batch in batches:
            for name, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source.get_file_info(f"{base}/{name}").type == pafs.FileType.File:
                    system.move(f"{base}/{name}", f"{target}/{pack}")
                elif system.get_file_info(f"{target}/{pack}").type != pafs.FileType.File:
                    raise RuntimeError(f"{name} is neither staged nor published")
            yield batch

    packs.select("name", "pack").mapInArrow(move, "name string, pack string").write.format("noop").mode("overwrite").save()


def consolidate(files: DataFrame, key: str, content: str, out: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write every whole record of `files` exactly once to packs in `out`, which must not hold
    any yet; returns the published packs (pack, n_records, n_bytes of records, stored_bytes)
    and the manifest of all records.

    Of copies the one in the smallest (pack, place) stays. Raises, and publishes nothing, if
    the packs read back don't hold just what the manifest holds. Empty input gives no packs.
    """
    spark = files.sparkSession
    staged, joined = new_scratch(spark, "packs"), new_scratch(spark, "joined")
    manifest = stage_packs(files, key, content, staged)
    kept = kept_records(manifest)
    packs = coalesce_packs(kept, staged, joined, most)
    read = settle(read_back(packs, joined), "readback")
    verify(kept, read)
    publish(packs, joined, out)
    for path in (staged, joined):
        delete_path(spark, path)
    done = settle(read.select("pack", "n_records", "n_bytes", "stored_bytes"), "published")
    discard(spark, read)
    return done, manifest
