"""Telemetry and decisions: recovery, forecasts, averages, hysteresis, scores, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import folds
from millrace.plans.base import Group, read

G = Group()

# hours after an overload's end; the second of two consecutive good hours is the answer. Only hours are windowed: their number is the time span's
_RECOVERY = """with s as (select {disc_steady} as p95 from {{events}} where ts < {t0}),
  h as (select hour, count(*) as n, {disc_hour} as p95 from (select cast(floor(({micros} - 1704844800000000) / 3600000000.0) as bigint) as hour, value from {{events}} where ts >= {t0}) e group by hour),
  g as (select hour, case when n >= 5 and h.p95 <= 1.25 * s.p95 then 1 else 0 end as good from h cross join s),
  b as (select hour, good, lag(hour) over (order by hour) as prev, lag(good) over (order by hour) as was from g)
  select min(hour) as recovered_hour, count(*) as good_pairs from b where good = 1 and was = 1 and prev = hour - 1"""
G.sql(
    "recovery_window",
    _RECOVERY.format(disc_steady="percentile_disc(0.95) within group (order by value)", disc_hour="percentile_disc(0.95) within group (order by value)", t0="timestamp_ntz '2024-01-10 00:00:00'", micros="unix_micros(cast(ts as timestamp))"),
    _RECOVERY.format(disc_steady="quantile_disc(value, 0.95)", disc_hour="quantile_disc(value, 0.95)", t0="timestamp '2024-01-10 00:00:00'", micros="epoch_us(ts)"),
)
_DAILY = "select event_type, cast(ts as date) as day, count(*) as n from {events} group by event_type, cast(ts as date)"
_ERRORS = f"""select event_type, count(*) as matured, cast(sum(abs(persistence)) as bigint) as persistence_abs, cast(sum(abs(linear)) as bigint) as linear_abs, cast(sum(persistence) as bigint) as persistence_sum, cast(sum(linear) as bigint) as linear_sum,
    cast(round(1000 * var_pop(persistence)) as bigint) as persistence_var_milli, count(*) filter (where abs(linear) < abs(persistence)) as linear_wins from (
      select event_type, n2 - n as persistence, n2 - (2 * n - was) as linear from (
        select event_type, n, lag(n) over (partition by event_type order by day) as was, lead(n, 2) over (partition by event_type order by day) as n2 from ({_DAILY}) d) w where was is not null and n2 is not null) t group by event_type"""
G.sql("predictor_errors", _ERRORS)


@G.frame(
    """with recursive d as (select event_type, cast(ts as date) as day, count(*) as x from events group by event_type, cast(ts as date)), s as (select event_type, x, row_number() over (partition by event_type order by day) as pos from d),
       f as (select distinct event_type, cast(0 as bigint) as pos, cast(0 as bigint) as q from s union all select f.event_type, s.pos, (3 * f.q + s.x) // 4 from f join s on s.event_type = f.event_type and s.pos = f.pos + 1)
       select event_type, max(pos) as n, max_by(q, pos) as average from f group by event_type"""
)
def ewma_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").selectExpr("event_type", "cast(ts as date) as day").groupBy("event_type", "day").count()
    return folds.ewma(daily, ["event_type"], "day", "count")


G.sql(
    "counter_change_split",
    f"""select event_type, changed, count(*) as points, cast(sum(n) as bigint) as total from (select event_type, n, case when n div 10 <> lag(n) over (partition by event_type order by day) div 10 then true else false end as changed from ({_DAILY}) d) t group by event_type, changed""",
    f"""select event_type, changed, count(*) as points, cast(sum(n) as bigint) as total from (select event_type, n, case when n // 10 <> lag(n) over (partition by event_type order by day) // 10 then true else false end as changed from ({_DAILY}) d) t group by event_type, changed""",
)
_HYST = "select event_type, day, cast(coalesce({last}, 8) as integer) as exposure from (select event_type, day, case when n >= 90 then 6 when n <= 60 then 8 end as step from (%s) d) t" % _DAILY
G.sql(
    "hysteresis_last_value",
    _HYST.replace("{last}", "last_value(step, true) over (partition by event_type order by day rows between unbounded preceding and current row)"),
    _HYST.replace("{last}", "last_value(step ignore nulls) over (partition by event_type order by day rows between unbounded preceding and current row)"),
)
G.sql(
    "score_rank_best",
    """select s_nationkey, s_suppkey, score from (select s_nationkey, s_suppkey, score, row_number() over (partition by s_nationkey order by score, s_suppkey) as place from (
         select s_nationkey, s_suppkey, (s_suppkey % 4) * 1000 + (cast(floor(abs(s_acctbal)) as bigint) % 100) * 10 + s_suppkey % 7 + (100 - s_suppkey % 100) as score from {supplier}) s) t where place = 1""",
)
_FIRST_REASON = "case when o_orderstatus = 'F' then 'closed' when o_totalprice > 400000 then 'over_limit' when o_orderpriority = '4-NOT SPECIFIED' then 'no_priority' when o_custkey % 11 = 0 then 'revoked' else 'allowed' end"
G.sql("policy_first_reason", f"select o_orderkey, {_FIRST_REASON} as reason from {{orders}}")
G.sql("composed_decision", "select o_custkey, coalesce(min_by(reason, o_orderkey) filter (where reason <> 'allowed'), 'allowed') as reason, count(*) as n from (select o_custkey, o_orderkey, %s as reason from {orders}) t group by o_custkey" % _FIRST_REASON)
G.sql(
    "policy_scores",
    """select event_id, score, case when score >= 1000 then 'override' when score >= 300 then 'high' else 'normal' end as class from (
         select event_id, greatest(100 + age, case when event_type = 'error' then 300 + age else 0 end, 200 + 25 * (user_id % 4), case when age >= 95 then 1000 else 0 end) as score from (select event_id, event_type, user_id, least(100, event_id % 120) as age from {events}) a) t""",
)
G.sql("expired_reservations", "select e.event_id, e.user_id, m.last_id - e.event_id as age from {events} e cross join (select max(event_id) as last_id from {events}) m where e.event_type = 'click' and m.last_id - e.event_id >= 200")
G.sql("score_conflict_overtakes", "select event_id, cast(place_by_score - place_by_age as bigint) as overtaken from (select event_id, row_number() over (partition by user_id order by value desc, event_id) as place_by_score, row_number() over (partition by user_id order by event_id) as place_by_age from {events}) t")
G.sql(
    "publication_checks",
    """select count(*) = count(distinct p_partkey) as unique_ids, min(p_partkey) as first_id, max(p_partkey) as last_id, count(*) filter (where p_retailprice < 0) as bad_price, count(*) filter (where p_type not in ('STANDARD', 'MEDIUM', 'ECONOMY', 'SMALL', 'PROMO', 'LARGE')) as bad_type, count(*) as n from {part}""",
)
