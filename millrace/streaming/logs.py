"""Streams over command logs: current state, duplicates, moving averages, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def current_state(log: DataFrame, key: str, sequence: str, *values: str) -> DataFrame:
    """The last values of each key so far (complete or update mode)."""
    return log.groupBy(key).agg(F.max_by(F.struct(*values), F.col(sequence)).alias("last"), F.max(sequence).alias(sequence)).select(key, sequence, "last.*")


def drop_replays(log: DataFrame, ids: list[str], time: str, horizon: str) -> DataFrame:
    """The first of each message within a horizon of event time; later ones may count as new, as with a bounded memory."""
    return log.withWatermark(time, horizon).dropDuplicatesWithinWatermark(ids)


def windows(log: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows, closed when the watermark passes."""
    return log.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def ewma(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, n, average after each batch: q' = (3 q + value) div 4 in order within the batch, carried in state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, q = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order)  # one micro-batch of one key
        for v in rows[value].tolist():
            n, q = n + 1, int((3 * q + v) / 4) if 3 * q + v < 0 else (3 * q + v) // 4
        state.update((n, q))
        yield pd.DataFrame({key: [k[0]], "n": [n], "average": [q]})

    out = f"{key} {log.schema[key].dataType.simpleString()}, n long, average long"
    return log.groupBy(key).applyInPandasWithState(step, out, "n long, q long", "update", GroupStateTimeout.NoTimeout)
