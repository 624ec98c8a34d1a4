"""Scans, filters, projections, limits, lookups and set-like reads over keyed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.records import overlay, take, typed
from millrace.plans.base import Group, read

G = Group()
CENTS = "cast(round({0} * 100) as bigint)"

G.sql("ordered_scan", "select n_nationkey, n_name, n_regionkey from {nation} order by n_nationkey")
G.sql("point_get", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from {orders} where o_orderkey = 77")
G.sql("scan_filter", "select o_orderkey, o_custkey, o_totalprice from {orders} where o_orderstatus = 'O'")
G.sql("scan_filter_map", "select o_orderkey * 2 as doubled from {orders} where o_orderstatus = 'O'")
G.sql("identity_map", "select r_regionkey, r_name from {region}")
G.sql("status_in_list", "select o_orderkey, o_orderstatus from {orders} where o_orderstatus in ('O', 'P')")
G.sql("count_all", "select count(*) as n from {orders}")
G.sql("filter_count", "select count(*) as n from {orders} where o_orderstatus = 'O'")
G.sql("first_match", "select o_orderkey, o_custkey from {orders} where o_orderstatus = 'F' order by o_orderkey limit 1")
G.sql("any_match", "select count(*) > 0 as found from (select 1 from {orders} where o_orderstatus = 'F' limit 1) t")
G.sql("low_stock_take", "select p_partkey, p_size from {part} where p_size <= 5 order by p_partkey limit 10")
G.sql("low_stock_ordered", "select p_size, p_partkey, p_name from {part} where p_size <= 5 order by p_size, p_partkey limit 20")
G.sql(
    "recent_orders_topk",
    """select o_custkey, o_orderkey, o_orderdate, place from (
         select o_custkey, o_orderkey, o_orderdate, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as bigint) as place from {orders}) t
       where place <= 10""",
)
G.sql("price_between", f"select p_partkey, price_cents from (select p_partkey, {CENTS.format('p_retailprice')} as price_cents from {{part}}) t where price_cents between 95000 and 120000 order by price_cents, p_partkey")
G.sql("active_region_projection", f"select p_partkey, {CENTS.format('p_retailprice')} as price_cents from {{part}} where p_type = 'PROMO' and p_size % 6 = 2")
G.sql("find_by_category", "select p_partkey, p_name, p_brand from {part} where p_type = 'PROMO' order by p_partkey")
G.sql("case_transfer", f"select c_custkey, case when c_custkey = 3 then {CENTS.format('c_acctbal')} - 100 when c_custkey = 5 then {CENTS.format('c_acctbal')} + 100 else {CENTS.format('c_acctbal')} end as balance_cents from {{customer}}")
G.sql("null_defaults", "select o_custkey, coalesce(sum(case when o_orderstatus = 'P' then 1 end), 0) as pending, nullif(count(*), 1) as several from {orders} group by o_custkey", "select o_custkey, cast(coalesce(sum(case when o_orderstatus = 'P' then 1 end), 0) as bigint) as pending, nullif(count(*), 1) as several from {orders} group by o_custkey")
G.sql("formatted_keys", "select p_partkey, concat('part-', lpad(cast(p_partkey as string), 6, '0')) as label, upper(trim(p_name)) as name, regexp_extract(p_brand, '#([0-9]+)', 1) as brand_no from {part}", "select p_partkey, concat('part-', lpad(cast(p_partkey as varchar), 6, '0')) as label, upper(trim(p_name)) as name, regexp_extract(p_brand, '#([0-9]+)', 1) as brand_no from {part}")


@G.frame("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' order by o_orderkey limit 10")
def ready_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O")
    return take(orders.select("o_orderkey", "o_custkey", "o_totalprice"), 10, "o_orderkey")


@G.frame("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def typed_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    records = part.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("key"), F.to_json(F.struct("*")).alias("json"))
    return typed(records, part.schema).select("v.*")


@G.frame(
    """select p_partkey, case when p_partkey % 10 = 0 then cast(round(p_retailprice * 100) as bigint) + 1 else cast(round(p_retailprice * 100) as bigint) end as price_cents
       from part where p_partkey % 15 <> 0"""
)
def overlay_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "part").select("p_partkey", F.expr(CENTS.format("p_retailprice")).alias("price_cents"))
    staged = base.where("p_partkey % 10 = 0 or p_partkey % 15 = 0").select("p_partkey", (F.col("price_cents") + 1).alias("price_cents"), (F.col("p_partkey") % 15 == 0).alias("deleted"))
    return overlay(base, staged, ["p_partkey"])


G.sql(
    "lane_equality",
    """select (select count(*) from (select p_partkey, p_size from {part} where p_brand = 'Brand#2' except all select p_partkey, p_size from {part} where p_brand like 'Brand#2' and p_partkey >= 0) a) as only_left,
              (select count(*) from (select p_partkey, p_size from {part} where p_brand like 'Brand#2' and p_partkey >= 0 except all select p_partkey, p_size from {part} where p_brand = 'Brand#2') b) as only_right""",
)
