"""Seeded rows, the same however they are split over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Multiplier, increment and seed of the linear congruential sequence modulo 2**64, and the first id.
MULTIPLIER, INCREMENT, SEED = 6364136223846793005, 1442695040888963407, 20260821
FIRST_ID = 1000001
_WRAP = 1 << 64


def jump(steps: int) -> tuple[int, int]:
    """(a, c): `steps` steps of the sequence at once are x * a + c."""
    a, c, step_a, step_c = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            a, c = a * step_a % _WRAP, (c * step_a + step_c) % _WRAP
        step_a, step_c = step_a * step_a % _WRAP, (step_c * step_a + step_c) % _WRAP
        steps >>= 1
    return a, c


def states(first: int, n: int) -> np.ndarray:
    """The sequence's values number first + 1 to first + n."""
    a, c = jump(first)
    start = (SEED * a + c) % _WRAP
    powers = np.full(n, MULTIPLIER, dtype=np.uint64)
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate((np.ones(1, dtype=np.uint64), powers[:-1])).cumsum(dtype=np.uint64)
    return powers * np.uint64(start) + np.uint64(INCREMENT) * sums


def products(spark: SparkSession, n: int) -> DataFrame:
    """n rows of the columnar product table; every task makes its own stretch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k = b["id"].to_numpy()
            s = states(int(k[0]), len(k))
            part = lambda shift, size: ((s >> np.uint64(shift)) % np.uint64(size)).astype(np.int64)
            yield pd.DataFrame({"id": k + FIRST_ID, "category": part(17, 8), "status": part(29, 3), "price_cents": 199 + part(7, 250_000), "rating_tenths": 10 + part(41, 41), "region": part(53, 6), "name": [f"Product-{i + 1:06d}" for i in k]})

    return spark.range(n).mapInPandas(run, "id long, category long, status long, price_cents long, rating_tenths long, region long, name string")
