"""Statistics that have a rule of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The odd multiplier of the table digest, and what its sums wrap at.
MULTIPLIER = "11400714785074694791"
WRAP = "18446744073709551616"


def table_digest(df: DataFrame, key: str, value: str) -> DataFrame:
    """n and digest: the sum of key * MULTIPLIER + value over all rows modulo 2**64, whatever their order. Each row is reduced first, so 38 digits never overflow."""
    row = F.expr(f"pmod(cast({key} as decimal(18,0)) * cast('{MULTIPLIER}' as decimal(20,0)) + cast({value} as decimal(18,0)), cast('{WRAP}' as decimal(20,0)))")
    total = F.expr(f"cast(cast(pmod(sum(r), cast('{WRAP}' as decimal(20,0))) as decimal(20,0)) as string)")
    return df.select(row.cast("decimal(20,0)").alias("r")).agg(F.count("*").alias("n"), total.alias("digest"))


def percentile_by_index(df: DataFrame, by: list[str], value: str, places: dict[str, str], count: str | None = None) -> DataFrame:
    """The value at index floor(places[name]) of each group's sorted values; the expression may use n, the group's size, which becomes the column `count` if one is named.

    Counts of equal values are aggregated first and the window runs over distinct values only, so a
    hot group shuffles its histogram, not its rows.
    """
    from pyspark.sql.window import Window

    histogram = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    cumulative = histogram.withColumns({"_upto": upto, "n": F.sum("_c").over(w)})
    at = {name: F.expr(f"cast(floor({expr}) as bigint)") for name, expr in places.items()}
    size = [F.sum("_c").alias(count)] if count else []
    return cumulative.groupBy(*by).agg(*size, *[F.min(F.when(F.col("_upto") > k, F.col(value))).alias(name) for name, k in at.items()])
