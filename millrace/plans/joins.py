"""Join-shaped checks: lookups, anti joins, reconciliation, intervals, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.intervals import within_seconds
from millrace.plans.base import Group, read

G = Group()

G.sql("orphan_records", "select o.o_orderkey, o.o_custkey from {orders} o where not exists (select 1 from {customer} c where c.c_custkey = o.o_custkey and c.c_custkey % 7 <> 0)")
G.sql("lookup_join", "select o.o_orderkey, c.c_name, n.n_name, case when c.c_custkey is null then 'not_found' when c.c_acctbal < 0 then 'insufficient' else 'placed' end as outcome from {orders} o left join {customer} c on o.o_custkey = c.c_custkey and c.c_mktsegment <> 'MACHINERY' left join {nation} n on c.c_nationkey = n.n_nationkey")
G.sql("inner_lookup", "select r.r_name, count(*) as nations from {nation} n join {region} r on n.n_regionkey = r.r_regionkey group by r.r_name")
G.sql("in_flight_value", "select count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from {orders} o where not exists (select 1 from {lineitem} l where l.l_orderkey = o.o_orderkey)")
G.sql(
    "transfer_outcomes",
    """select outcome, count(*) as n from (select case when l.l_orderkey is null then 'unresolved' when o.o_orderstatus = 'F' then 'rejected' else 'success' end as outcome
       from {orders} o left join (select distinct l_orderkey from {lineitem}) l on l.l_orderkey = o.o_orderkey) t group by outcome""",
)
G.sql("customers_with_orders", "select c_custkey, c_name from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")
_PHASES = "(select 'warm' as phase, timestamp{0} '2024-01-01 00:00:00' as s, timestamp{0} '2024-01-05 00:00:00' as e union all select 'load', timestamp{0} '2024-01-05 00:00:00', timestamp{0} '2024-01-20 12:00:00' union all select 'rest', timestamp{0} '2024-01-20 12:00:00', timestamp{0} '2024-02-01 00:00:00')"
_PHASE_QUERY = "select p.phase, count(*) as n, max({ms}) as worst from {{events}} e join {phases} p on e.ts >= p.s and e.ts <= p.e group by p.phase"
_MS = "cast(round(e.value * 1000) as bigint)"
# three phases, written into the query: the side that is broadcast is fixed
G.sql("phase_interval_join", _PHASE_QUERY.format(ms=_MS, phases=_PHASES.format("_ntz")).replace("select p.phase", "select /*+ broadcast(p) */ p.phase"), _PHASE_QUERY.format(ms=_MS, phases=_PHASES.format("")))
G.sql(
    "mutual_acceptance",
    """with t as (select user_id, collect_set(event_type) as have from {events} where value > 60 group by user_id)
       select a.user_id, array_join(array_sort(array_except(array_intersect(a.have, b.have), array('error'))), ',') as shared from t a join t b on b.user_id = a.user_id + 1""",
    """with t as (select user_id, list_distinct(list(event_type)) as have from {events} where value > 60 group by user_id)
       select a.user_id, array_to_string(list_sort(list_filter(list_intersect(a.have, b.have), lambda x: x <> 'error')), ',') as shared from t a join t b on b.user_id = a.user_id + 1""",
)
G.sql(
    "array_contains_all",
    "select user_id, forall(array('click', 'view', 'purchase'), x -> array_contains(have, x)) as has_all, size(have) as n from (select user_id, collect_set(event_type) as have from {events} where value > 80 group by user_id) t",
    "select user_id, list_has_all(have, ['click', 'view', 'purchase']) as has_all, cast(len(have) as integer) as n from (select user_id, list_distinct(list(event_type)) as have from {events} where value > 80 group by user_id) t",
)


@G.frame("select a.event_id as left_id, b.event_id as right_id, a.user_id from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id and epoch_us(b.ts) - epoch_us(a.ts) between 0 and 600000000")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pairs = within_seconds(events, ["user_id"], "us", 600)
    return pairs.where("l.event_id < r.event_id").selectExpr("l.event_id as left_id", "r.event_id as right_id", "user_id")
