"""Ordered folds: accounts, inventory, moving averages, cross-account transfers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.records import current_state

#: How event types stand for account commands on the test tables.
KINDS = {"signup": "create", "click": "deposit", "purchase": "withdraw", "error": "freeze", "view": "unfreeze"}


def ordered(df: DataFrame, key: list[str], order: str, *values: str) -> DataFrame:
    """key and rows: each key's values sorted by order. What a key gathers is its own log."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("rows"))


def account_log(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    return events.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.floor("value").cast("long").alias("amount"))


def _decide(a: Column, x: Column) -> tuple[Column, Column, Column]:
    """(accepted, balance, frozen) after command x in state a. The amount is judged before the account for money, the account first for creation."""
    kind, amount = x["kind"], x["amount"]
    money = (amount > 0) & a["present"]
    accepted = (
        F.when(kind == "create", ~a["present"] & (amount >= 0))
        .when(kind == "deposit", money)
        .when(kind == "withdraw", money & ~a["frozen"] & (a["balance"] >= amount))
        .otherwise(a["present"])
    )
    moved = F.when(kind == "create", amount).when(kind == "deposit", amount).when(kind == "withdraw", -amount).otherwise(F.lit(0).cast("long"))
    frozen = F.when(kind == "freeze", True).when(kind == "unfreeze", False).otherwise(a["frozen"])
    return accepted, a["balance"] + F.when(accepted, moved).otherwise(F.lit(0).cast("long")), F.when(accepted, frozen).otherwise(a["frozen"])


def accounts(log: DataFrame, key: str = "user_id") -> DataFrame:
    """key, present, balance, frozen, version, rejected, turns from log (key, seq, kind, amount): single-account commands folded in order."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(False).alias("present"), zero.alias("balance"), F.lit(False).alias("frozen"), zero.alias("version"), zero.alias("rejected"), zero.alias("turns"))

    def step(a: Column, x: Column) -> Column:
        ok, balance, frozen = _decide(a, x)
        one = ok.cast("long")
        return F.struct((a["present"] | (ok & (x["kind"] == "create"))).alias("present"), balance.alias("balance"), frozen.alias("frozen"), (a["version"] + one).alias("version"), (a["rejected"] + 1 - one).alias("rejected"), (a["turns"] + 1).alias("turns"))

    state = ordered(log, [key], "seq", "kind", "amount").select(key, F.aggregate("rows", start, step).alias("s"))
    return state.select(key, "s.present", "s.balance", "s.frozen", "s.version", "s.rejected", "s.turns")


def account_decisions(log: DataFrame, key: str = "user_id") -> DataFrame:
    """key, seq, kind, amount, accepted, effect (1 create, 2 money, 4 freeze; 0 refused) of every command.

    A key's commands pass one by one in order, so what is held is one account, however long its log.
    """
    schema = f"{key} {dict(log.dtypes)[key]}, seq long, kind string, amount long, accepted boolean, effect int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, present, balance, frozen = object(), False, 0, False
        for pdf in batches:
            said = []
            for k, kind, amount in zip(pdf[key], pdf["kind"], pdf["amount"], strict=True):
                if k != at:
                    at, present, balance, frozen = k, False, 0, False
                if kind == "create":
                    ok = not present and amount >= 0
                    present, balance = (True, amount) if ok else (present, balance)
                elif kind == "deposit":
                    ok = amount > 0 and present
                    balance += amount if ok else 0
                elif kind == "withdraw":
                    ok = amount > 0 and present and not frozen and balance >= amount
                    balance -= amount if ok else 0
                else:
                    ok = present
                    frozen = kind == "freeze" if ok else frozen
                said.append(ok)
            effect = pdf["kind"].map({"create": 1, "deposit": 2, "withdraw": 2}).fillna(4).astype("int32")
            yield pdf.assign(accepted=said, effect=effect.where(pd.Series(said, index=pdf.index, dtype=bool), 0).astype("int32"))

    return log.select(key, "seq", "kind", "amount").repartition(key).sortWithinPartitions(key, "seq").mapInPandas(run, schema)


def inventory(log: DataFrame) -> DataFrame:
    """item, stock, refused from log (item, seq, release, quantity): a reservation beyond the stock and a quantity of 0 or less are refused."""
    zero = F.lit(0).cast("long")

    def step(a: Column, x: Column) -> Column:
        ok = (x["quantity"] > 0) & (x["release"] | (a["stock"] >= x["quantity"]))
        change = F.when(x["release"], x["quantity"]).otherwise(-x["quantity"])
        return F.struct((a["stock"] + F.when(ok, change).otherwise(zero)).alias("stock"), (a["refused"] + 1 - ok.cast("long")).alias("refused"))

    rows = ordered(log, ["item"], "seq", "release", "quantity")
    return rows.select("item", F.aggregate("rows", F.struct(zero.alias("stock"), zero.alias("refused")), step).alias("s")).select("item", "s.stock", "s.refused")


def ewma(series: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """key, n, average: q' = (3 q + value) div 4 with integer division, in order, from 0."""
    rows = ordered(series, key, order, value)
    last = F.expr(f"aggregate(rows, named_struct('n', 0L, 'q', 0L), (a, x) -> named_struct('n', a.n + 1, 'q', (3 * a.q + x.{value}) div 4))")
    return rows.select(*key, last.alias("s")).select(*key, F.col("s.n").alias("n"), F.col("s.q").alias("average"))


def resume(snapshot: DataFrame, log: DataFrame, key: list[str], sequence: str, at: int) -> DataFrame:
    """State at the end of log from a snapshot taken at sequence `at` and the rows after it."""
    return current_state(snapshot.unionByName(log.where(F.col(sequence) > at)), key, sequence)


def transfers(log: DataFrame) -> DataFrame:
    """seq, account, other, accepted, reason, balance (of the source after it): commands that couple accounts, in order.

    Accounts that share no transfer cannot affect each other, but which do is known only from the log:
    the log is folded in sequence by one task. Use `accounts` where commands name one account.
    """
    schema = "seq long, account long, other long, kind string, accepted boolean, reason string, balance long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, list] = {}
        pending: dict[int, tuple[int, int]] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b, amount, reason = state.get(r.account), state.get(r.other), r.amount, ""
                if r.kind == "create":
                    reason = "account_exists" if a else "invalid_amount" if amount < 0 else ""
                    if not reason:
                        state[r.account] = [amount, False]
                elif r.kind in ("freeze", "unfreeze"):
                    reason = "" if a else "account_missing"
                    if a:
                        a[1] = r.kind == "freeze"
                elif r.kind == "begin_transfer":
                    reason = "invalid_amount" if amount <= 0 else ""
                    if not reason:
                        pending[r.account] = (r.other, amount)  # in place of one that was pending
                elif r.kind == "cancel":
                    pending.pop(r.account, None)  # accepted whether or not one was pending
                elif r.kind == "confirm" and pending.pop(r.account, None) != (r.other, amount):
                    reason = "invalid_workflow"  # whatever was pending is gone
                else:
                    couple = r.kind in ("transfer", "confirm")
                    reason = "invalid_amount" if amount <= 0 else "account_missing" if a is None or (couple and b is None) else ""
                    if not reason and r.kind != "deposit":
                        reason = "account_frozen" if a[1] else "insufficient_funds" if a[0] < amount else ""
                    if not reason:
                        a[0] += amount if r.kind == "deposit" else -amount
                        if couple:
                            b[0] += amount
                source = state.get(r.account)
                out.append((r.seq, r.account, r.other, r.kind, not reason, reason, source[0] if source else None))
            yield pd.DataFrame(out, columns=["seq", "account", "other", "kind", "accepted", "reason", "balance"]).astype({"balance": "Int64", "other": "Int64"})

    return log.select("seq", "account", "other", "kind", "amount").repartition(1).sortWithinPartitions("seq").mapInPandas(fold, schema)
