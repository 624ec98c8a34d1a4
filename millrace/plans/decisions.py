"""Commands and their decisions: mutations, jobs, capacity, caches, controllers, transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import generate
from millrace.operators import folds
from millrace.plans.base import Group, fold, read

G = Group()
ZERO, NONE = "cast(0 as bigint)", "cast(null as string)"
VARCHAR = {"as string)": "as varchar)"}

# a command puts a value, deletes it or is rejected with a code and a result; the first with an id decides for all
_COMMANDS = """select event_id, user_id, event_type, props as command_id, cast(floor(value) as bigint) as amount, row_number() over (partition by props order by event_id) as turn, min(event_id) over (partition by props) as sequence from {events}"""
_CODE = "case when event_type = 'error' then 'locked' when amount < 5 then 'too_small' else '' end"
_RESULT = "concat(chr(123), '\"amount\":', cast(amount as string), ',\"user\":', cast(user_id as string), chr(125))"  # braces by number, as braces name tables here
_DECISIONS = f"select sequence, command_id, event_type, user_id, amount, {_CODE} as code, {_CODE} = '' as applied, case when {_CODE} = 'too_small' then '' else {_RESULT} end as result from ({_COMMANDS}) c where turn = 1"
duck = lambda text: text.replace("as string)", "as varchar)")
G.sql("mutation_log", f"select d.sequence, d.command_id, d.applied, d.code, d.result, c.event_id, c.turn > 1 as duplicate from ({_COMMANDS}) c join ({_DECISIONS}) d on d.command_id = c.command_id", duck(f"select d.sequence, d.command_id, d.applied, d.code, d.result, c.event_id, c.turn > 1 as duplicate from ({_COMMANDS}) c join ({_DECISIONS}) d on d.command_id = c.command_id"))
G.sql("rejected_decisions", f"select sequence, command_id, code, result from ({_DECISIONS}) d where not applied", duck(f"select sequence, command_id, code, result from ({_DECISIONS}) d where not applied"))
G.sql(
    "decode_result",
    f"select command_id, from_json(nullif(result, ''), 'amount bigint, user bigint').amount as amount, from_json(nullif(result, ''), 'amount bigint, user bigint').user as user_id, case when result = '' then 'invalid_input' else '' end as error from ({_DECISIONS}) d",
    duck(f"select command_id, cast(json_extract_string(nullif(result, ''), '$.amount') as bigint) as amount, cast(json_extract_string(nullif(result, ''), '$.user') as bigint) as user_id, case when result = '' then 'invalid_input' else '' end as error from ({_DECISIONS}) d"),
)
# an applied command writes its own key and deletes the one beside it; writes of one command stand in key order
_WRITES = f"select sequence, concat('u', cast(user_id as string), '/', event_type) as key, false as deleted, amount as value from ({_DECISIONS}) d where applied union all select sequence, concat('u', cast(user_id + 1 as string), '/', event_type), true, cast(null as bigint) from ({_DECISIONS}) e where applied"
G.sql("mutation_writes", f"select sequence, key, deleted, value, cast(row_number() over (partition by sequence order by key) as bigint) as place from ({_WRITES}) w", duck(f"select sequence, key, deleted, value, cast(row_number() over (partition by sequence order by key) as bigint) as place from ({_WRITES}) w"))
G.sql("state_from_mutations", f"select key, max_by(value, sequence) as value from ({_WRITES}) w group by key having not max_by(deleted, sequence)", duck(f"select key, arg_max_null(value, sequence) as value from ({_WRITES}) w group by key having not max_by(deleted, sequence)"))
_CHECK = "case when trim(id) = '' then 'invalid_input: command id' when length(id) > 40 then 'capacity: command id' when event_type = 'error' then 'invalid_input: mutation' when value > 400 then 'capacity: result' else 'ok' end"
_GIVEN = "select event_type, value, case when event_id % 7 = 0 then '  ' when event_id % 11 = 0 then repeat(props, 5) else props end as id from {events}"
G.sql("validate_commands", f"select {_CHECK} as verdict, count(*) as n from ({_GIVEN}) g group by {_CHECK}")
G.sql("insert_ignore", "select o_custkey, o_orderkey, kept = o_orderkey as inserted from (select o_custkey, o_orderkey, min(o_orderkey) over (partition by o_custkey) as kept from {orders}) t")
G.sql("out_of_domain_status", "select o_orderkey from {orders} where o_orderstatus = 'X'")
G.sql("union_runs", "select run, event_type, count(*) as n, max(value) as worst from (select 'first' as run, event_type, value from {events} where ts < timestamp '2024-01-10 00:00:00' union all select 'second', event_type, value from {events} where ts >= timestamp '2024-01-10 00:00:00') r group by run, event_type".replace("timestamp '", "cast('").replace("00:00:00'", "00:00:00' as timestamp)"))
G.sql("counter_ratios", "select event_type, cast(errors as double) / nullif(n, 0) as per_event, case when heavy > 0 then cast(errors as double) / heavy end as per_heavy from (select event_type, count(*) as n, count(*) filter (where value < 20) as errors, count(*) filter (where value > 300) as heavy from {events} group by event_type) c")
G.sql("array_places", "select user_id, array_position(have, 'error') as error_at, size(have) as n from (select user_id, array_sort(collect_set(event_type)) as have from {events} where value > 60 group by user_id) t", "select user_id, coalesce(list_position(have, 'error'), 0)::bigint as error_at, cast(len(have) as integer) as n from (select user_id, list_sort(list_distinct(list(event_type))) as have from {events} where value > 60 group by user_id) t")
G.sql("dotted_path", "select event_id, cast(get_json_object(props, '$.k') as bigint) as k, get_json_object(props, '$.k.x') as deeper from {events}", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.k.x') as deeper from {events}")
G.sql("byte_order", "select p_partkey, lower(hex(encode(p_name, 'utf-8'))) as bytes, cast(row_number() over (partition by p_brand order by p_name, p_partkey) as bigint) as place from {part}", "select p_partkey, lower(hex(encode(p_name))) as bytes, cast(row_number() over (partition by p_brand order by p_name, p_partkey) as bigint) as place from {part}")
G.sql("bounded_trace", "select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by event_id) as arrival from {events}) t where arrival <= 256")
G.sql("peak_in_flight", "select user_id, cast(max(running) as bigint) as peak, max(n) as events from (select user_id, sum(case when event_type in ('click', 'view') then 1 else -1 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as running, count(*) over (partition by user_id) as n from {events}) t group by user_id")
G.sql(
    "freshness_check",
    """select o_custkey, verified, case when verified >= 2 then 'healthy' else 'degraded' end as health, case when verified >= 2 then 'none' else coalesce(first_reason, 'no_alternate') end as reason from (
         select o_custkey, count(*) filter (where reason is null) as verified, min_by(reason, o_orderkey) filter (where reason is not null) as first_reason from (
           select o_custkey, o_orderkey, case when o_orderpriority like '1%' then 'revoked' when o_orderstatus = 'P' then 'unavailable' when o_custkey % 5 = o_orderkey % 5 then 'policy_incompatible' when o_orderpriority like '2%' then 'version_changed' when o_totalprice < 100000 then 'expired' end as reason from {orders}) r group by o_custkey) t""",
)

_EVENTS = "select user_id, event_id, event_type, cast(floor(value) as bigint) as amount, cast(floor(value / 100) as bigint) as owner from {events}"
# create, claim, complete, fail and requeue of one job a user
fold(
    G, "job_lifecycle", _EVENTS, "user_id", "event_id", ["event_type", "owner"],
    {
        "applied": (ZERO, "{a}applied + case when {code} = '' then 1 else 0 end"),
        "rejected": (ZERO, "{a}rejected + case when {code} = '' then 0 else 1 end"),
        "attempts": (ZERO, "{a}attempts + case when {code} = '' and {x}event_type = 'click' then 1 else 0 end"),
        "owner": ("cast(-1 as bigint)", "case when {code} <> '' or {x}event_type = 'purchase' then {a}owner when {x}event_type = 'click' then {x}owner else cast(-1 as bigint) end"),
        "failure": ("''", "case when {code} <> '' or {x}event_type = 'purchase' then {a}failure when {x}event_type = 'error' then 'failed' else '' end"),
        "last_code": ("''", "case when {code} = '' then {a}last_code else {code} end"),
        "status": ("''", "case when {code} <> '' then {a}status when {x}event_type in ('signup', 'view') then 'ready' when {x}event_type = 'click' then 'claimed' when {x}event_type = 'purchase' then 'completed' else 'failed' end"),
    },
    "status, owner, attempts, failure, applied, rejected, last_code",
    terms={"code": "case when {x}event_type = 'signup' then case when {a}status <> '' then 'job_exists' else '' end when {a}status = '' then 'not_found' when {x}event_type = 'click' then case when {a}status in ('ready', 'failed') then '' else 'not_claimable' end when {x}event_type in ('purchase', 'error') then case when {a}status = 'claimed' and {a}owner = {x}owner then '' else 'not_owner' end else case when {a}status = 'failed' then '' else 'not_failed' end end"},
)
# the first provider in the request's order with capacity left; a day's use is counted from nothing
fold(
    G, "capacity_walk", "select cast(cast(ts as date) as string) as day, event_id, cast(user_id % 5 as int) as first from {events}", "day", "event_id", ["first"],
    {
        "fallbacks": (ZERO, "{a}fallbacks + case when {at} > 0 then 1 else 0 end"),
        "saturated": (ZERO, "{a}saturated + case when {at} < 0 then 1 else 0 end"),
        "calls": (ZERO, "{a}calls + case when {at} < 0 then 5 else {at} + 1 end"),
        "used": ("array(0, 0, 0, 0, 0)", "transform({a}used, (n, i) -> case when {at} >= 0 and i = ({x}first + {at}) % 5 then n + 1 else n end)"),
    },
    "fallbacks, saturated, calls, array_join(used, ',') as used",
    terms={"at": "case when get({a}used, {x}first) < 60 then 0 when get({a}used, ({x}first + 1) % 5) < 50 then 1 when get({a}used, ({x}first + 2) % 5) < 60 then 2 when get({a}used, ({x}first + 3) % 5) < 60 then 3 when get({a}used, ({x}first + 4) % 5) < 60 then 4 else -1 end"},
    duck={"as string)": "as varchar)", "array(0, 0, 0, 0, 0)": "[0, 0, 0, 0, 0]", "get(f.used, ": "list_extract(f.used, 1 + ", "transform(f.used, (n, i) -> case": "list_transform(f.used, lambda n, i: case", "i = (l.first": "i - 1 = (l.first", "array_join(used": "array_to_string(used"},
)
# an attestation is good for eight rounds of an hour
fold(
    G, "attestation_cache", "select user_id, event_id, event_type, datediff(cast(ts as date), cast('2024-01-01' as date)) as round from {events}", "user_id", "event_id", ["round"],
    {
        "fresh": (ZERO, "{a}fresh + case when {hit} then 0 else 1 end"),
        "cached": (ZERO, "{a}cached + case when {hit} then 1 else 0 end"),
        "valid_until": ("-1", "case when {hit} then {a}valid_until else {x}round + 8 end"),
    },
    "fresh, cached, cast(valid_until as bigint) as valid_until", terms={"hit": "{a}valid_until >= {x}round"},
    duck={"datediff(cast(ts as date), cast('2024-01-01' as date))": "cast(datediff('day', cast('2024-01-01' as date), cast(ts as date)) as integer)"},
)
# an action is held for three turns, and then unless another scores more by fifty; an emergency overrides and leaves it
fold(
    G, "min_commit_controller", _EVENTS, "user_id", "event_id", ["event_type", "amount", "owner"],
    {
        "overrides": (ZERO, "{a}overrides + case when {urgent} then 1 else 0 end"),
        "commit_holds": (ZERO, "{a}commit_holds + case when not {urgent} and {held} and {x}event_type <> {a}current and {a}age < 3 then 1 else 0 end"),
        "score_holds": (ZERO, "{a}score_holds + case when not {urgent} and {held} and {x}event_type <> {a}current and {a}age >= 3 then 1 else 0 end"),
        "switches": (ZERO, "{a}switches + case when not {urgent} and not {kept} and {a}current <> '' then 1 else 0 end"),
        "age": (ZERO, "case when {urgent} then {a}age when {kept} then {a}age + 1 else 1 end"),
        "score": (ZERO, "case when {urgent} or {held} then {a}score else {x}amount end"),
        "current": ("''", "case when {urgent} or {held} then {a}current else {x}event_type end"),
    },
    "current as action, score, age, overrides, commit_holds, score_holds, switches",
    terms={"urgent": "{x}amount >= 300", "held": "{a}current <> '' and ({a}age < 3 or {x}amount <= {a}score + 50)", "kept": "{held} or {a}current = {x}event_type"},
)
# a batch takes up to eight requests of one kind
fold(
    G, "microbatch_gather", _EVENTS, "user_id", "event_id", ["event_type"],
    {
        "batches": (ZERO, "{a}batches + case when {joins} then 0 else 1 end"),
        "largest": (ZERO, "greatest({a}largest, case when {joins} then {a}size + 1 else 1 end)"),
        "filled": (ZERO, "{a}filled + case when {joins} and {a}size = 3 then 1 else 0 end"),
        "size": (ZERO, "case when {joins} then {a}size + 1 else 1 end"),
        "kind": ("''", "{x}event_type"),
    },
    "batches, largest, filled", terms={"joins": "{a}kind = {x}event_type and {a}size < 4"},
)
# reserve, offer, accept, commit, acknowledge; a step out of turn is refused, a rejection frees the reservation
fold(
    G, "transfer_machine", _EVENTS, "user_id", "event_id", ["event_type", "amount"],
    {
        "settled": (ZERO, "{a}settled + case when {next} = 'acknowledged' then 1 else 0 end"),
        "freed": (ZERO, "{a}freed + case when {next} = 'rejected' then 1 else 0 end"),
        "refused": (ZERO, "{a}refused + case when {next} = '' then 1 else 0 end"),
        "reserved": (ZERO, "case when {next} = 'reserved' then {x}amount when {next} in ('acknowledged', 'rejected') then cast(0 as bigint) else {a}reserved end"),
        "state": ("'idle'", "case when {next} = '' then {a}state else {next} end"),
    },
    "state, reserved, settled, freed, refused",
    terms={"next": "case when {a}state in ('idle', 'acknowledged', 'rejected') then case when {x}event_type in ('view', 'signup') and {x}amount > 0 then 'reserved' else '' end when {x}event_type = 'error' and {a}state <> 'committed' then 'rejected' when {a}state = 'reserved' and {x}event_type in ('view', 'click') then 'accepted' when {a}state = 'accepted' and {x}event_type in ('click', 'purchase') then 'committed' when {a}state = 'committed' and {x}event_type in ('view', 'purchase') then 'acknowledged' else '' end"},
)
# an id is a duplicate while it is among the last three admitted; after that it is admitted again
fold(
    G, "horizon_readmission", _EVENTS, "user_id", "event_id", ["event_type"],
    {
        "admitted": (ZERO, "{a}admitted + case when array_contains({a}recent, {x}event_type) then 0 else 1 end"),
        "duplicates": (ZERO, "{a}duplicates + case when array_contains({a}recent, {x}event_type) then 1 else 0 end"),
        "recent": ("cast(array() as array<string>)", "case when array_contains({a}recent, {x}event_type) then {a}recent when size({a}recent) < 3 then concat({a}recent, array({x}event_type)) else concat(slice({a}recent, 2, 2), array({x}event_type)) end"),
    },
    "admitted, duplicates, array_join(recent, ',') as recent",
    duck={"cast(array() as array<string>)": "cast([] as varchar[])", "array_contains(": "list_contains(", "size(f": "len(f", "concat(f.recent, array(l.event_type))": "list_append(f.recent, l.event_type)", "concat(slice(f.recent, 2, 2), array(l.event_type))": "list_append(f.recent[2:3], l.event_type)", "array_join(recent": "array_to_string(recent"},
)
# no more than four requests of a user in flight
fold(
    G, "admission_decision", _EVENTS, "user_id", "event_id", ["event_type", "amount"],
    {
        "admitted": (ZERO, "{a}admitted + case when {arrives} and {a}in_flight < 4 then 1 else 0 end"),
        "rejected": (ZERO, "{a}rejected + case when {arrives} and {a}in_flight >= 4 then 1 else 0 end"),
        "peak": (ZERO, "greatest({a}peak, {a}in_flight + case when {arrives} and {a}in_flight < 4 then 1 else 0 end)"),
        "in_flight": (ZERO, "case when {arrives} then least({a}in_flight + 1, 4) else greatest({a}in_flight - 2, 0) end"),
    },
    "admitted, rejected, peak, in_flight", terms={"arrives": "{x}event_type in ('click', 'view', 'signup')"},
)


@G.frame(
    """with recursive g as (select cast(0 as bigint) as k, cast(20260821 as uhugeint) as s union all select k + 1, (s * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 from g where k < 10000)
       select k + 1000000 as id, cast((s // 131072) % 8 as bigint) as category, cast((s // 536870912) % 3 as bigint) as status, 199 + cast((s // 128) % 250000 as bigint) as price_cents, 10 + cast((s // 2199023255552) % 41 as bigint) as rating_tenths,
         cast((s // 9007199254740992) % 6 as bigint) as region, 'Product-' || lpad(cast(k as varchar), 6, '0') as name from g where k > 0"""
)
def generated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.products(spark, 10_000)


_LOG = "select event_id as seq, user_id as account, case when (user_id * 7 + 3) % 150 = user_id then (user_id + 1) % 150 else (user_id * 7 + 3) % 150 end as other, case event_type when 'signup' then 'create' when 'click' then 'deposit' when 'purchase' then 'transfer' when 'view' then 'begin_transfer' else 'confirm' end as kind, cast(floor(value) as bigint) as amount from {events}"


_AMONG = "case kind when 'create' then case when a is not null then 'account_exists' when amount < 0 then 'invalid_amount' else '' end when 'deposit' then case when amount <= 0 then 'invalid_amount' when a is null then 'account_missing' else '' end when 'begin_transfer' then case when amount <= 0 then 'invalid_amount' else '' end else case when kind = 'confirm' and (target is null or target <> other or held <> amount) then 'invalid_workflow' when amount <= 0 then 'invalid_amount' when a is null or b is null then 'account_missing' when a < amount then 'insufficient_funds' else '' end end"


@G.frame(
    f"""with recursive l as (select *, row_number() over (order by seq) as pos from ({_LOG.replace("{events}", "events")}) g),
       f as (select cast(0 as bigint) as pos, cast(null as bigint) as seq, cast(null as bigint) as account, cast(null as bigint) as other, '' as kind, '' as reason, cast(null as bigint) as balance,
               list_transform(range(0, (select max(user_id) + 151 from events)), lambda i: cast(null as bigint)) as bal, list_transform(range(0, (select max(user_id) + 151 from events)), lambda i: cast(null as bigint)) as targets, list_transform(range(0, (select max(user_id) + 151 from events)), lambda i: cast(0 as bigint)) as amounts
             union all
             select pos, seq, account, other, kind, reason, moved[account + 1], moved,
               case when kind = 'begin_transfer' and reason = '' then list_transform(targets, lambda v, i: case when i = account + 1 then other else v end) when kind = 'confirm' then list_transform(targets, lambda v, i: case when i = account + 1 then null else v end) else targets end,
               case when kind = 'begin_transfer' and reason = '' then list_transform(amounts, lambda v, i: case when i = account + 1 then amount else v end) else amounts end
             from (select *, case when reason <> '' or kind = 'begin_transfer' then bal else list_transform(bal, lambda v, i: case when i = account + 1 then case kind when 'create' then amount when 'deposit' then v + amount else v - amount end when i = other + 1 and kind in ('transfer', 'confirm') then v + amount else v end) end as moved
               from (select *, {_AMONG} as reason from (select l.*, f.bal, f.targets, f.amounts, f.bal[l.account + 1] as a, f.bal[l.other + 1] as b, f.targets[l.account + 1] as target, f.amounts[l.account + 1] as held from f join l on l.pos = f.pos + 1) x) y) z)
       select seq, account, other, kind, reason = '' as accepted, reason, balance from f where pos > 0"""
)
def transfer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.transfers(spark.sql(_LOG, events=read(spark, sf_dir, "events")))
