"""State from a command log: folds, versions, ledger, dedupe, gaps, snapshot and tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import folds
from millrace.operators.records import current_state, first_wins, gaps, retained
from millrace.plans.base import Group, read

G = Group()


@G.frame("select user_id, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value, max(event_id) as event_id from events group by user_id having max_by(event_type, event_id) <> 'error'")
def current_state_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", (F.col("event_type") == "error").alias("deleted"))
    return current_state(log, ["user_id"], "event_id", "deleted").drop("deleted")


@G.frame("select props, min(event_id) as event_id, min_by(user_id, event_id) as user_id from events group by props")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(read(spark, sf_dir, "events").select("props", "event_id", "user_id"), ["props"], "event_id")


@G.frame("select event_id, user_id, event_type from events where event_type <> 'error' order by event_id desc limit 100")
def retained_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(read(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "user_id", "event_type"), "event_id", 100)


@G.frame('select event_id as "after" from (select event_id, lead(event_id) over (order by event_id) as nxt from events where event_id % 97 <> 0) t where nxt <> event_id + 1')
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(read(spark, sf_dir, "events").where("event_id % 97 <> 0"), "event_id")


@G.frame("select user_id, max_by(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    snapshot = current_state(log.where("event_id <= 5000"), ["user_id"], "event_id")
    return folds.resume(snapshot, log, ["user_id"], "event_id", 5000)


G.sql("log_stats", "select count(*) as decisions, max(event_id) + 1 as committed, count(distinct user_id) as accounts, count(distinct props) as commands, count(*) filter (where event_type = 'error') as rejected from {events}")
_ACCOUNTS = """with recursive log as (select user_id, event_type as k, cast(floor(value) as bigint) as amt, row_number() over (partition by user_id order by event_id) as pos from events),
    fold as (
      select user_id, cast(0 as bigint) as pos, false as present, cast(0 as bigint) as balance, false as frozen, cast(0 as bigint) as version, cast(0 as bigint) as rejected from (select distinct user_id from events) u
      union all
      select f.user_id, f.lpos,
        f.present or ok and k = 'signup',
        case when not ok then balance when k = 'signup' then amt when k = 'click' then balance + amt when k = 'purchase' then balance - amt else balance end,
        case when not ok then frozen when k = 'error' then true when k = 'view' then false else frozen end,
        version + case when ok then 1 else 0 end, rejected + case when ok then 0 else 1 end
      from (select f.*, l.pos as lpos, l.k, l.amt, case l.k when 'signup' then not present and l.amt >= 0 when 'click' then l.amt > 0 and present when 'purchase' then l.amt > 0 and present and not frozen and balance >= l.amt else present end as ok
            from fold f join log l on l.user_id = f.user_id and l.pos = f.pos + 1) f)
    """
_LAST = "from (select *, row_number() over (partition by user_id order by pos desc) as back from fold) t where back = 1"


@G.frame(_ACCOUNTS + "select user_id, balance, frozen, version, rejected, pos as turns " + _LAST)
def account_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.accounts(folds.account_log(read(spark, sf_dir, "events"))).drop("present")


@G.frame(_ACCOUNTS + "select user_id, balance, frozen, version " + _LAST + " and present order by user_id")
def sorted_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.accounts(folds.account_log(read(spark, sf_dir, "events"))).where("present").select("user_id", "balance", "frozen", "version").orderBy("user_id")


@G.frame(_ACCOUNTS + "select cast(id as bigint) as user_id, coalesce(present, false) as found, case when present then balance end as balance from (select 7 as id union all select -1) ids left join (select * " + _LAST + ") a on a.user_id = ids.id")
def account_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts, of which one was never named; only their own commands are folded."""
    log = folds.account_log(read(spark, sf_dir, "events").where("user_id in (7, -1)"))
    ids = spark.createDataFrame([(7,), (-1,)], "user_id long")
    return ids.join(folds.accounts(log), "user_id", "left").selectExpr("user_id", "coalesce(present, false) as found", "case when present then balance end as balance")


@G.frame(_ACCOUNTS + "select user_id, version, pos as turns " + _LAST)
def account_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.accounts(folds.account_log(read(spark, sf_dir, "events"))).select("user_id", "version", "turns")


_LEDGER = _ACCOUNTS.replace("event_type as k,", "event_id, event_type as k,").replace("cast(0 as bigint) as rejected from (select", "cast(0 as bigint) as rejected, cast(null as bigint) as event_id, cast(null as varchar) as k, cast(0 as bigint) as amt, false as ok from (select").replace("rejected + case when ok then 0 else 1 end", "rejected + case when ok then 0 else 1 end, event_id, k, amt, ok").replace("(select f.*, l.pos", "(select f.user_id, f.present, f.balance, f.frozen, f.version, f.rejected, l.event_id, l.pos")


@G.frame(
    _LEDGER
    + """select user_id, event_id, case k when 'signup' then 'create' when 'click' then 'deposit' when 'purchase' then 'withdraw' when 'error' then 'freeze' else 'unfreeze' end as kind, amt as amount,
         case when k = 'signup' then 1 when k in ('click', 'purchase') then 2 else 4 end as effect from fold where ok"""
)
def ledger_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = folds.account_decisions(folds.account_log(read(spark, sf_dir, "events")))
    return decided.where("accepted").select("user_id", F.col("seq").alias("event_id"), "kind", "amount", "effect")


@G.frame(
    """with recursive log as (select user_id, event_type as k, cast(floor(value) as bigint) as amt, row_number() over (partition by user_id order by event_id) as pos from events where event_type in ('click', 'purchase')),
       fold as (select user_id, cast(0 as bigint) as pos, cast(0 as bigint) as stock, cast(0 as bigint) as refused from (select distinct user_id from log) u
         union all select f.user_id, l.pos, case when k = 'click' and amt > 0 then stock + amt when k = 'purchase' and amt > 0 and stock >= amt then stock - amt else stock end,
           refused + case when amt <= 0 or (k = 'purchase' and stock < amt) then 1 else 0 end from fold f join log l on l.user_id = f.user_id and l.pos = f.pos + 1)
       select user_id, stock, refused from (select *, row_number() over (partition by user_id order by pos desc) as back from fold) t where back = 1"""
)
def inventory_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").selectExpr("user_id as item", "event_id as seq", "event_type = 'click' as release", "cast(floor(value) as bigint) as quantity")
    return folds.inventory(log).withColumnRenamed("item", "user_id")


_PAIRS = "select user_id, event_id, lag(event_type) over (partition by user_id order by event_id) as was, event_type as now, lag(value) over (partition by user_id order by event_id) as old_value, value as new_value from {events}"
G.sql("invalid_transitions", f"select was, now, count(*) as n from ({_PAIRS}) t where was is not null and concat(was, '>', now) not in ('signup>view', 'view>click', 'click>purchase', 'view>view', 'click>click', 'purchase>view') group by was, now")
G.sql(
    "version_diff",
    f"select user_id, event_id, array_join(filter(array(case when was <> now then 'type_changed' end, case when new_value > old_value then 'raised' end, case when new_value < old_value then 'lowered' end), x -> x is not null), ',') as changes, new_value > old_value as expanded from ({_PAIRS}) t where was is not null",
    f"select user_id, event_id, array_to_string(list_filter([case when was <> now then 'type_changed' end, case when new_value > old_value then 'raised' end, case when new_value < old_value then 'lowered' end], lambda x: x is not null), ',') as changes, new_value > old_value as expanded from ({_PAIRS}) t where was is not null",
)
# a line's number is its order's version: each must be the one before it plus one
G.sql("version_continuity", "select l_orderkey, count(*) as breaks from (select l_orderkey, l_linenumber, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) as prev from {lineitem}) t where l_linenumber <> coalesce(prev, 0) + 1 group by l_orderkey")
