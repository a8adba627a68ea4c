"""Journals as streams: the reuse policy and progressive snapshots of resumable batch work
as Structured Streaming. An extension; batch and stream give the same latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.operators.resume import latest
from quire.session import delete_path


def journal_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Attempts as they are appended to a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


#: Batches after which a store is merged into one base.
COMPACT_EVERY = 16


def keep_latest(attempts: DataFrame, keys: list[str], order: list[str], store: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the latest attempt of each key in the folder `store`. A batch adds its own latest
    rows as one part, named by its number, so that a batch that is run again writes the same
    part, and costs what the batch is worth; now and then parts are merged into a base, and
    what the base holds is deleted. `latest_rows` reads the store."""

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [F.col(c) for c in order]).write.mode("overwrite").parquet(f"{store}/part={number:09d}")
        if number and number % compact_every == 0:
            compact(batch.sparkSession, store, keys, order, number)

    return attempts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _pieces(spark: SparkSession, store: str, kind: str) -> dict[int, str]:
    """Number -> path of the whole parts or bases in a store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{store}/{kind}=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = [s.getPath().getParent() for s in found]
    return {int(p.getName().split("=")[1]): p.toString() for p in paths}


def latest_rows(spark: SparkSession, store: str, keys: list[str], order: list[str], upto: int | None = None) -> DataFrame | None:
    """The latest attempt of each key: those of the newest base and of the parts behind it.
    None for a store without any."""
    bases = {n: p for n, p in _pieces(spark, store, "base").items() if upto is None or n < upto}
    base = max(bases, default=-1)
    parts = [p for n, p in _pieces(spark, store, "part").items() if n > base and (upto is None or n <= upto)]
    paths = [*parts, *([bases[base]] if bases else [])]
    return latest(spark.read.parquet(*paths), keys, [F.col(c) for c in order]) if paths else None


def compact(spark: SparkSession, store: str, keys: list[str], order: list[str], number: int) -> None:
    """Write the rows up to and with a part as a base, then delete what it holds. Run again,
    or cut off in between, it leaves a store that reads the same."""
    rows = latest_rows(spark, store, keys, order, number)
    if rows is None:
        return
    rows.write.mode("overwrite").parquet(f"{store}/base={number:09d}")
    old = [p for n, p in _pieces(spark, store, "base").items() if n < number] + [p for n, p in _pieces(spark, store, "part").items() if n <= number]
    for path in old:
        delete_path(spark, path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and keys, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
