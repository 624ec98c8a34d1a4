"""DuckDB SQL for the operators that SQL expresses. The others are tested against plain versions in tests/llm."""

from __future__ import annotations

from millrace.llm.urls import BLOCK_SHARE, DAMPING, LINK, RULES
from millrace.llm.quality import STOP_WORDS, SYMBOLS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP1 = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
tri as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from w, unnest(range(1, len(ws) - 1)) r(i)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from tri) x where c > 1),
cov as (select rid, count(distinct i + j) as n from rep, (values (0), (1), (2)) v(j) group by rid),
m as (select w.rid, doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines,
  len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') in ({_STOP}))) as stops, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as alphas,
  len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as dots, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•‣▪]'))) as bullets from w left join cov on cov.rid = w.rid),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.0 and 20.0 and n_symbols / n_words <= 0.3 and stops / n_words >= 0.02 and alphas / n_words >= 0.6
  and n_dup_lines / n_lines <= 0.5 and dots / n_lines <= 0.5 and bullets / n_lines <= 0.9 as kept from v"""

OP4 = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
chunk as (select rid, length(h) // 2 as n, k * 100 as base, substr(h, k * 200 + 1, 598) as c from d, unnest(range(0, (greatest(length(h) // 2 - 199, 0) + 99) // 100)) r(k)),
win as (select rid, base + j as p, md5(substr(c, j * 2 + 1, 400)) as m from chunk, unnest(range(0, 100)) r(j) where base + j <= n - 200),
dup as (select rid, p from (select rid, p, count(*) over (partition by m) as c from win) x where c > 1),
stepped as (select rid, p, case when p - lag(p) over (partition by rid order by p) <= 200 then 0 else 1 end as opens from dup),
island as (select rid, min(p) as s, max(p) + 200 as e from (select rid, p, sum(opens) over (partition by rid order by p) as g from stepped) x group by rid, g),
piece as (select rid, s, e, coalesce(lag(e) over (partition by rid order by s), 0) as prev from island),
cut as (select d.rid, count(*) as n_spans, sum(e - s) as gone, string_agg(substr(h, prev * 2 + 1, (s - prev) * 2), '' order by s) || substr(any_value(h), max(e) * 2 + 1) as kept from piece join d on d.rid = piece.rid group by d.rid)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut on cut.rid = d.rid"""

OP9 = """
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f"""

_RULE = "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{{}}'".format(v) for r in sorted(RULES, key=lambda r: (-len(r.name), r.name)) for v in ("NAME:" + r.name + ":" + r.verdict,)) + " end"


def _rounds(name: str, verdict: str, src: str, dst: str, n: int = 60) -> str:
    """Rounds of PageRank along links from src to dst, from the hosts of pages with the verdict; n is beyond what the operator runs until it settles."""
    parts = [
        f"{name}_out as materialized (select {src} as a, {dst} as b, w / sum(w) over (partition by {src}) as p from link)",
        f"{name}_seed as materialized (select host as node, count(*) / sum(count(*)) over () as seed from judged where ruled = '{verdict}' and host <> '' group by host)",
        f"{name}_0 as (select '' as node, cast(0 as double) as s where false)",
    ]
    for k in range(1, n + 1):
        parts.append(f"{name}_{k} as materialized (select b as node, sum({DAMPING} * s * p) as s from {name}_out join (select node, sum(s) as s from (select node, {1 - DAMPING} * seed as s from {name}_seed union all select node, s from {name}_{k - 1}) x group by node) y on a = node group by b)")
    return ", ".join(parts)


OP7 = rf"""
with split as (select page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
judged as materialized (select page_id, html, host, path, string_split(r, ':')[2] as rule, string_split(r, ':')[3] as ruled from (select *, {_RULE} as r from split) x),
link as materialized (select src, dst, count(*) as w from (select host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) as dst from judged) x where src <> '' and src <> dst group by src, dst),
{_rounds("t", "allow", "src", "dst")}, {_rounds("d", "block", "dst", "src")}
select page_id, host, path, rule, coalesce(ruled, case when coalesce(d_60.s, 0) > 0 and d_60.s >= {BLOCK_SHARE} * (coalesce(t_60.s, 0) + d_60.s) then 'block' else 'allow' end) as verdict
from judged left join t_60 on t_60.node = host left join d_60 on d_60.node = host"""

ORACLES = {"op1_quality_rules": OP1, "op4_suffix_dedup": OP4, "op7_url_filter": OP7, "op9_warc": OP9}
