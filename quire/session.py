"""Session builder and the shared scratch folder in which lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Paths of the tables and folders made in a scratch folder, by application.
_made: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with the scheme of its file system. Where none
    is named a temporary one is set, but only in local mode: on a cluster the executors would
    each write to a disk of their own."""
    context = spark.sparkContext
    folder = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    named = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", named).rstrip("/")


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path inside the scratch folder; release() deletes what was written there."""
    path = f"{scratch_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the scratch folder and read it back: its lineage ends there and it
    survives the loss of any executor."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by settle()."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(spark, name)


def release(spark: SparkSession) -> int:
    """Delete everything this application has put into the scratch folder, and tell how many
    paths that were. Results that haven't been read or written by then are lost."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
