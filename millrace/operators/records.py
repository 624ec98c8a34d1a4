"""Keyed records: typed scans, ordered takes, overlays, current state, first-wins dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What a missing field reads as, by type.
ZEROS = {"string": "", "bigint": 0, "int": 0, "smallint": 0, "tinyint": 0, "double": 0.0, "float": 0.0, "boolean": False}


def typed(records: DataFrame, schema: T.StructType, zero: bool = True) -> DataFrame:
    """records (key, json) with the decoded value as column v. A malformed record or a wrong type fails the scan; a missing field is its type's zero."""
    v = F.from_json("json", schema, {"mode": "FAILFAST"})
    out = records.select("key", v.alias("v"))
    if not zero:
        return out
    fields = [F.coalesce(F.col(f"v.{f.name}"), F.lit(ZEROS[f.dataType.simpleString()]).cast(f.dataType)).alias(f.name) if f.dataType.simpleString() in ZEROS else F.col(f"v.{f.name}") for f in schema.fields]
    return out.select("key", F.struct(*fields).alias("v"))


def take(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in order; none, without a scan, for n of 0 or less."""
    return df.orderBy(*order).limit(n) if n > 0 else df.where(F.lit(False))


def overlay(base: DataFrame, staged: DataFrame, key: list[str], deleted: str = "deleted") -> DataFrame:
    """base with staged rows in place of those of equal key; a staged row marked deleted hides its key."""
    live = staged.where(~F.col(deleted)).select(*base.columns)
    return base.join(staged.select(*key), key, "left_anti").unionByName(live)


def current_state(mutations: DataFrame, key: list[str], sequence: str, deleted: str | None = None) -> DataFrame:
    """The last row of each key by sequence, without those that delete. One aggregation, combined before the shuffle."""
    rest = [c for c in mutations.columns if c not in key]
    last = mutations.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_last")).select(*key, "_last.*")
    return last.where(~F.col(deleted)) if deleted else last


def first_wins(decisions: DataFrame, command: list[str], sequence: str) -> DataFrame:
    """The first row of each command id: later ones are duplicates that get its result."""
    rest = [c for c in decisions.columns if c not in command]
    return decisions.groupBy(*command).agg(F.min_by(F.struct(*rest), F.col(sequence)).alias("_first")).select(*command, "_first.*")


def retained(decisions: DataFrame, sequence: str, horizon: int) -> DataFrame:
    """The decisions still in a horizon of the last `horizon` ones."""
    return decisions.orderBy(F.desc(sequence)).limit(horizon)


def gaps(log: DataFrame, sequence: str) -> DataFrame:
    """after: each sequence number, save the last, that has no successor. No window over the whole log."""
    s = log.select(F.col(sequence).alias("after"))
    nexts = log.select((F.col(sequence) - 1).alias("after"))
    last = log.agg(F.max(sequence).alias("last"))
    return s.join(nexts, "after", "left_anti").join(F.broadcast(last), F.col("after") < F.col("last")).select("after")


def running(by: list[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*order)
