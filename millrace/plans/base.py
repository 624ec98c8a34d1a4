"""How a query and its oracle are declared."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
TABLE = re.compile(r"\{(\w+)\}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement(text: str) -> Query:
    """The query of an SQL text whose tables stand in braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in set(TABLE.findall(text))})

    return run


class Group:
    """Queries with their oracles, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in SQL; without an oracle of its own the same text serves."""
        self.queries[name] = statement(text)
        self.oracles[name] = TABLE.sub(r"\1", oracle or text)

    def frame(self, oracle: str | None) -> Callable[[Query], Query]:
        """A query as a function of DataFrames, named like it."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return keep


def fold(group: Group, name: str, log: str, key: str, order: str, fields: list[str], state: dict[str, tuple[str, str]], select: str, terms: dict[str, str] | None = None, duck: dict[str, str] | None = None) -> None:
    """A query that folds each key's rows in order, by aggregate() in Spark and by recursion in the oracle.

    state: column to (initial value, value after a row); expressions name state columns as {a}column and a row's
    fields as {x}field. terms: expressions that others use by name. duck: what DuckDB spells otherwise.
    """

    def spelt(text: str, a: str, x: str) -> str:
        for _ in range(4):
            for k, v in (terms or {}).items():
                text = text.replace("{%s}" % k, f"({v})")
        return text.replace("{a}", a).replace("{x}", x)

    def for_duck(text: str) -> str:
        for k, v in (duck or {}).items():
            text = text.replace(k, v)
        return text

    step = ", ".join(f"'{c}', {spelt(v, 'a.', 'x.')}" for c, (_, v) in state.items())
    start = ", ".join(f"'{c}', {v}" for c, (v, _) in state.items())
    rows = ", ".join(f"'{c}', {c}" for c in fields)
    outer = ", ".join(f"s.{c}" for c in state)
    spark_text = f"""select {key}, {select} from (select {key}, {outer} from (select {key}, aggregate(array_sort(collect_list(named_struct('_at', {order}, {rows}))), named_struct({start}), (a, x) -> named_struct({step})) as s
        from ({log}) l group by {key}) f) t"""
    inits = ", ".join(f"{v} as {c}" for c, (v, _) in state.items())
    steps = ", ".join(spelt(v, "f.", "l.") for _, v in state.values())
    duck_text = f"""with recursive l as (select *, row_number() over (partition by {key} order by {order}) as _pos from ({log}) g),
        f as (select {key}, cast(0 as bigint) as _pos, {inits} from (select distinct {key} from l) u union all select f.{key}, l._pos, {steps} from f join l on l.{key} = f.{key} and l._pos = f._pos + 1)
        select {key}, {select} from (select *, row_number() over (partition by {key} order by _pos desc) as _back from f) t where _back = 1"""
    group.sql(name, spark_text, for_duck(duck_text))
