"""Joins on closeness in time as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_seconds(df: DataFrame, token: list[str], micros: str, seconds: int) -> DataFrame:
    """token, l, r: pairs of rows with one token, r at most `seconds` after l (or at the same time).

    A row is looked up in its own bucket and the next, so the join is on equal keys and a hot token is spread over time.
    """
    width = seconds * 1_000_000
    rest = [c for c in df.columns if c not in token]
    left = df.select(*token, F.struct(*rest).alias("l"), F.explode(F.array(F.expr(f"{micros} div {width}"), F.expr(f"{micros} div {width} + 1"))).alias("_bucket"))
    right = df.select(*token, F.struct(*rest).alias("r"), F.expr(f"{micros} div {width}").alias("_bucket"))
    gap = F.col(f"r.{micros}") - F.col(f"l.{micros}")
    return left.join(right, [*token, "_bucket"]).where((gap >= 0) & (gap <= width)).drop("_bucket")
