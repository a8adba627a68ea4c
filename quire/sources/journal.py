"""JSON records on disk: snapshots, append-only journals, label lists, staged output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import is_blank
from quire.operators.resume import set_fingerprint
from quire.operators.validate import enforce, evidence_violations
from quire.session import delete_path

# ---------------------------------------------------------------- readers


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of which every one must be sound; a byte-order mark at the start is
    allowed and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON file that holds one document or a list."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_training(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Training rows from a `.json` list or from JSON lines, by suffix; none is an error."""
    rows = read_document(spark, path, schema) if path.endswith(".json") else read_snapshot(spark, path, schema)
    if rows.isEmpty():
        raise ValueError("training rows are missing")
    return rows


JOURNAL = T.StructType([T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("status", T.StringType()), T.StructField("record", T.StringType())])


def journal_lines(content: bytes) -> Iterator[tuple[int, str, str]]:
    """(line number, ok / torn / broken, text) of a journal's lines, blank ones aside. Marks
    of byte order are dropped line by line. A last record that is broken and has no line
    end was torn by a crash; any other broken one is an error."""
    lines = content.split(b"\n")
    last = max((i for i, x in enumerate(lines) if x.strip()), default=-1)
    for i, line in enumerate(lines):
        line = line.removeprefix(b"\xef\xbb\xbf").strip()
        if not line:
            continue
        try:
            text = line.decode("utf-8")
            if not isinstance(json.loads(text), dict):
                raise ValueError("not a record")
            yield i + 1, "ok", text
        except ValueError:
            torn = i == last and i == len(lines) - 1
            yield i + 1, "torn" if torn else "broken", line.decode("utf-8", "replace")


def read_journal(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Records of append-only journals with `_path` and `_line_no`. A torn last record is
    left out; with `strict` any other broken line raises and names its file and line. A
    path without files gives no rows."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found or len(found) == 0:
        return spark.createDataFrame([], T.StructType([*struct, T.StructField("_path", T.StringType()), T.StructField("_line_no", T.LongType())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, *r) for r in journal_lines(content)]
                if strict and (bad := next((r for r in rows if r[2] == "broken"), None)):
                    raise ValueError(f"{name}, line {bad[1]}: broken record")
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=JOURNAL.names)

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, JOURNAL).filter("status = 'ok'")
    return raw.select(F.from_json("record", struct).alias("r"), "path", "line_no").select("r.*", F.col("path").alias("_path"), F.col("line_no").alias("_line_no"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image, text) of `image<TAB>text` lists. Quotes are text. A line without exactly two
    fields, or with a blank text, has a null `text` and its whole line as `bad`."""
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    parts = F.split("value", "\t")
    fine = (F.size(parts) == 2) & ~is_blank(F.get(parts, F.lit(1)))
    return lines.select(F.get(parts, F.lit(0)).alias("image"), F.when(fine, F.get(parts, F.lit(1))).alias("text"), F.when(~fine, F.col("value")).alias("bad"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) of `word count` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.lower(F.get(parts, F.lit(0))).alias("word"), F.get(parts, F.lit(1)).cast("bigint").alias("count"))


# ---------------------------------------------------------------- writers


def _endless(col: Column, dtype: T.DataType) -> Column | None:
    """Whether a value holds a NaN or an infinity anywhere; None for types that can't."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.isnan(col) | (F.abs(col) == float("inf"))
    if isinstance(dtype, T.ArrayType):
        return F.exists(col, lambda x: F.coalesce(_endless(x, dtype.elementType), F.lit(False))) if _endless(col, dtype.elementType) is not None else None
    if isinstance(dtype, T.MapType):
        return F.exists(F.map_values(col), lambda x: F.coalesce(_endless(x, dtype.valueType), F.lit(False))) if _endless(col, dtype.valueType) is not None else None
    if isinstance(dtype, T.StructType):
        inner = [e for f in dtype if (e := _endless(col.getField(f.name), f.dataType)) is not None]
        return reduce(lambda a, b: a | b, [F.coalesce(e, F.lit(False)) for e in inner]) if inner else None
    return None


def _refuse_non_finite(df: DataFrame) -> DataFrame:
    """Raise where a number is NaN or infinite, however deep, while the rows are written."""
    out = df
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        bad = _endless(c, f.dataType)
        if bad is not None:
            out = out.withColumn(f.name, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{f.name}: numbers must be finite")).cast(f.dataType)).otherwise(c))
    return out


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines at once: rows go to a staged folder beside it, which
    takes its place only when all are written, so the old snapshot survives a failure."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        _refuse_non_finite(df).write.option("ignoreNullFields", "false").json(staged)
    except BaseException:
        delete_path(spark, staged)
        raise
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), at):
        fs.rename(jvm.org.apache.hadoop.fs.Path(old), at)
        raise OSError(f"can't publish {path}")
    delete_path(spark, old)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a journal folder."""
    _refuse_non_finite(df).write.mode("append").option("ignoreNullFields", "false").json(path)


def guarded_output(spark: SparkSession, path: str, fingerprint: str) -> str:
    """A folder for the dataset of this fingerprint; one that holds another's is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = jvm.org.apache.hadoop.fs.Path(path, f"_fingerprint={fingerprint}")
    if fs.exists(at) and len(fs.listStatus(at)) > 0 and not fs.exists(mark):
        raise FileExistsError(f"{path} holds another dataset")
    fs.mkdirs(at)
    fs.create(mark, True).close()
    return path


def write_markdown(sections: DataFrame, path: str) -> None:
    """Sections (id, section) as text, in the order of their ids within each file."""
    sections.sortWithinPartitions("id").select("section").write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """(image, text) as `image<TAB>text` lines. Raises, while writing, on a blank text or on a
    field with a tab or a line end."""
    fine = ~is_blank(F.col("text")) & F.col("image").isNotNull() & ~F.concat("image", "text").rlike(r"[\t\r\n]")
    line = F.concat_ws("\t", "image", "text")
    labels.select(F.when(F.coalesce(fine, F.lit(False)), line).otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce("image", F.lit("null"))))).alias("value")).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, report: DataFrame, path: str) -> None:
    """A small table of results as one JSON document of rows."""
    write_snapshot(report.coalesce(1), path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    """Character evidence (line_id, source, probs, alphabet, blank_id, excluded_mass) as a
    table; raises on evidence that breaks a rule, and then leaves what was there."""
    enforce(evidence_violations(evidence))
    evidence.write.mode("overwrite").parquet(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence that was written before, checked again: files may have been changed."""
    found = spark.read.parquet(path)
    enforce(evidence_violations(found))
    return found


def model_stamp(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of a model's files, from their listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def adapter_signature(spark: SparkSession, path: str) -> str:
    """One hash of the names and contents of an adapter's files."""
    files = file_hashes(spark, path).select(F.lit(0).alias("k"), F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    row = set_fingerprint(files, ["k"], F.col("name"), F.col("sha256")).first()
    return row["fingerprint"] if row else ""
