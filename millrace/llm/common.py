"""What the corpus operators share: table access, durable cuts of lineage, small expression helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own is set only where the session names none and runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """df computed once, in replicated storage; a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spill(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder as a table and read again, for results too large to keep as rows; and its path."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, label))
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what spill() wrote, once nothing will read it again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for the row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, where the session has kept Spark's own bound; batches of plain numbers are smaller in any case."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so few rows and bytes (a single row may hold more) that a worker unpacks little at a time."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows
