"""Counts, digests, percentiles under three index rules, histograms, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.stats import percentile_by_index, table_digest as digest_of
from millrace.plans.base import Group, read

G = Group()

G.sql(
    "verify_invariants",
    """select count(*) filter (where l_quantity <= 0) as bad_quantity, count(*) filter (where l_discount < 0 or l_discount > 1) as bad_discount,
              count(*) filter (where l_returnflag not in ('A', 'N', 'R')) as bad_flag, coalesce(bool_and(l_tax >= 0), true) as tax_ok, count(*) as n from {lineitem}""",
)
G.sql(
    "bounds_violations",
    """select name, n from (select 'nation' as name, count(*) as n, 10 as bound from {nation} union all select 'region', count(*), 10 from {region} union all select 'supplier', count(*), 5 from {supplier}) t where n > bound""",
)
G.sql("sum_by_status", "select o_orderstatus, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, max(o_orderkey) as last_key from {orders} group by o_orderstatus")


@G.frame("select count(*) as n, cast(sum(((p_partkey::hugeint * 11400714785074694791 + cast(round(p_retailprice * 100) as bigint)) % 18446744073709551616)) % 18446744073709551616 as varchar) as digest from part")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of(read(spark, sf_dir, "part"), "p_partkey", "cast(round(p_retailprice * 100) as bigint)")


# the list is hashed by stretches of 4096 keys, then over the stretches, so that no task gathers the whole table
G.sql(
    "ordered_fingerprint",
    """select sha2(array_join(transform(array_sort(collect_list(struct(part, h))), x -> x.h), ','), 256) as fingerprint from (
         select p_partkey div 4096 as part, sha2(array_join(transform(array_sort(collect_list(struct(p_partkey, cents))), x -> concat(x.p_partkey, ':', x.cents)), ','), 256) as h
         from (select p_partkey, cast(round(p_retailprice * 100) as bigint) as cents from {part}) p group by p_partkey div 4096) t""",
    """select sha256(string_agg(h, ',' order by part)) as fingerprint from (
         select p_partkey // 4096 as part, sha256(string_agg(concat(p_partkey, ':', cents), ',' order by p_partkey)) as h
         from (select p_partkey, cast(round(p_retailprice * 100) as bigint) as cents from {part}) p group by p_partkey // 4096) t""",
)

LATENCY = "cast(round(value * 1000) as bigint)"
_PERCENTILES = """select event_type, count(*) as n, cast({0}(0.5) within group (order by ns) as bigint) as p50, cast({0}(0.95) within group (order by ns) as bigint) as p95, cast({0}(0.99) within group (order by ns) as bigint) as p99,
       case when count(*) >= 1000 then cast({0}(0.999) within group (order by ns) as bigint) end as p999 from (select event_type, %s as ns from {{events}}) t group by event_type""" % LATENCY  # fmt: skip


@G.frame(_PERCENTILES.format("percentile_disc").replace("{events}", "events"))
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_type", f"{LATENCY} as ns")
    ranks = percentile_by_index(rows, ["event_type"], "ns", {f"p{k}": f"ceil({p}BD * n) - 1" for k, p in ((50, "0.5"), (95, "0.95"), (99, "0.99"), (999, "0.999"))}, "n")
    return ranks.selectExpr("event_type", "n", "p50", "p95", "p99", "case when n >= 1000 then p999 end as p999")


_INDEXED = """select event_type, max(case when place = cast(floor({0}) as bigint) + 1 then ns end) as p50, max(case when place = cast(floor({1}) as bigint) + 1 then ns end) as p99 from (
    select event_type, %s as ns, row_number() over (partition by event_type order by %s, event_id) as place, count(*) over (partition by event_type) as n from events) t group by event_type""" % (LATENCY, LATENCY)  # fmt: skip


@G.frame(_INDEXED.format("0.5 * (n - 1)", "0.99 * (n - 1)"))
def phase_percentiles_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_type", f"{LATENCY} as ns")
    return percentile_by_index(rows, ["event_type"], "ns", {"p50": "0.5D * (n - 1)", "p99": "0.99D * (n - 1)"})


@G.frame(_INDEXED.format("0.5 * (n - 1) + 0.5", "0.99 * (n - 1) + 0.5"))
def percentile_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_type", f"{LATENCY} as ns")
    return percentile_by_index(rows, ["event_type"], "ns", {"p50": "0.5D * (n - 1) + 0.5D", "p99": "0.99D * (n - 1) + 0.5D"})


G.sql("median_min_max", "select l_returnflag, l_linestatus, median(l_quantity) as mid, min(l_quantity) as low, max(l_quantity) as high from {lineitem} group by l_returnflag, l_linestatus")
G.sql(
    "lane_ratio_pivot",
    """select user_id, clicks, views, purchases, cast(clicks as double) / nullif(views, 0) as click_per_view from (
         select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'view') as views, count(*) filter (where event_type = 'purchase') as purchases from {events} group by user_id) t""",
)
G.sql(
    "batch_histogram",
    """select size, batches, requests, cast(requests / batches as bigint) as fill from (
         select size, count(*) as batches, cast(sum(size) as bigint) as requests from (select l_orderkey, count(*) as size from {lineitem} group by l_orderkey) o group by size) t""",
)
G.sql(
    "outcome_counts",
    """select count(*) as attempted, count(*) filter (where outcome = 'rejected') as rejected, count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'completed') as completed from (
         select case when value < 5 then 'rejected' when event_type = 'error' then 'failed' else 'completed' end as outcome from {events}) t""",
)


@G.frame(f"select cast(cast(ts as date) as varchar) as phase, event_type, user_id % 3 as priority, count(*) as n, quantile_disc({LATENCY}, 0.95) as p95, max({LATENCY}) as worst from events group by cast(cast(ts as date) as varchar), event_type, user_id % 3")
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("cast(cast(ts as date) as string) as phase", "event_type", "user_id % 3 as priority", f"{LATENCY} as ns")
    return percentile_by_index(rows, ["phase", "event_type", "priority"], "ns", {"p95": "ceil(0.95BD * n) - 1", "worst": "n - 1"}, "n")


G.sql(
    "concentration_hhi",
    """select event_type, active, total, top1, top3, cast(round(1000000 * cast(squares as double) / (cast(total as double) * total)) as bigint) as hhi_millionths from (
         select event_type, count(*) as active, cast(sum(n) as bigint) as total, cast(sum(case when place <= 1 then n else 0 end) as bigint) as top1, cast(sum(case when place <= 3 then n else 0 end) as bigint) as top3, cast(sum(n * n) as bigint) as squares
         from (select event_type, user_id, n, row_number() over (partition by event_type order by n desc, user_id) as place from (select event_type, user_id, count(*) as n from {events} group by event_type, user_id) c) r group by event_type) t""",
)
G.sql("distinct_by_prefix", "select count(distinct case when p_name like 'red%' then p_partkey end) as red, count(distinct case when p_name like 'small%' then p_brand end) as small_brands, count(distinct p_type) as types from {part}")
G.sql("double_apply", "select l_orderkey, cast(sum(greatest(n - 1, 0)) as bigint) as extra from (select l_orderkey, l_linenumber, count(*) as n from {lineitem} group by l_orderkey, l_linenumber) t group by l_orderkey")
G.sql("derived_rates", "select user_id, count(*) as n, case when count(*) filter (where event_type = 'purchase') > 0 then cast(count(*) as double) / count(*) filter (where event_type = 'purchase') end as per_purchase from {events} group by user_id")
