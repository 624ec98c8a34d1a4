"""Operator 7, URL filters: rules, then trust and distrust propagated over links between hosts.

A rule names a host (it fits the host and its subdomains) and the beginning of a path; the longest rule
that fits decides. Other pages are judged by their host: personalised PageRank spreads trust from the
hosts of allowed pages along links and distrust from the hosts of blocked pages against them (who links
to a blocked host is suspect). Seeds weigh as their pages do. What a host gets back as a seed says
nothing beyond its rules and is left out: a page of a blocked seed host that no rule fits is judged by the
links alone. A host whose share of distrust in what reaches it is at least BLOCK_SHARE is blocked, any
other allowed. Rounds go on until a round changes less than TOLERANCE of the seeds' weight in all and
reaches no new host, so a host far from every seed is judged too.

All of it is SQL expressions, aggregations and joins. Links are aggregated by pair of hosts before they
meet the scores; scores are cut from their lineage by durable checkpoints. A host that much links to is
summed in parts before the shuffle, one that links to much is left to adaptive skew splitting. Links within
a host are left out.

Nulls and odd input: a null url, or one without `://`, has an empty host and path, fits no rule and is
allowed; a null html has no link. Long pages are searched whole. Repeated pages count as often as they stand
and each give a row. A tie between trust and distrust blocks (share one half). Extra columns are ignored. An
empty table gives an empty result. Rules are compiled into one expression, so their number must be at most
MAX_RULES; of rules of one name the verdict later in the alphabet stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
TOLERANCE = 1e-4
#: Rounds between two tests of TOLERANCE.
STRIDE = 4
BLOCK_SHARE = 0.5
MAX_RULES = 500
LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def compile_rules(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The name and the verdict of the rule for the columns host and path; null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name, r.verdict)):  # the longest is tried first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: how many pages of host src link to host dst. pages has host and html."""
    to = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    found = pages.select(F.col("host").alias("src"), F.explode(to).alias("dst")).where("src <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """node, reached: personalised PageRank less what a node gets as a seed. links: src, dst, w; seeds: node, seed (sums to 1)."""
    out = links.groupBy("src").agg(F.sum("w").alias("out"))
    steps = durable(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    seeds = durable(seeds)
    if steps.isEmpty() or seeds.isEmpty():
        return seeds.select("node", F.lit(0.0).alias("reached")).where("false")
    reached, k, n = None, 0, 0
    while True:
        score = seeds.select("node", ((1 - damping) * F.col("seed")).alias("s"))
        if reached is not None:
            score = score.unionAll(reached.select("node", F.col("reached").alias("s")))
        score = score.groupBy("node").agg(F.sum("s").alias("s"))
        moved = steps.join(score, steps["src"] == score["node"]).select(F.col("dst").alias("node"), (damping * F.col("s") * F.col("p")).alias("s"))
        now, k = moved.groupBy("node").agg(F.sum("s").alias("reached")), k + 1
        if k % STRIDE:
            reached = now
            continue
        now = durable(now)
        # what a node is reached by only grows from round to round, so the sums tell how much has changed
        last = reached.agg(F.count("*").alias("n"), F.sum("reached").alias("s")).first()
        here = now.agg(F.count("*").alias("n"), F.sum("reached").alias("s")).first()
        settled = here["n"] == last["n"] == n and (here["s"] or 0.0) - (last["s"] or 0.0) < tolerance
        reached, n = now, here["n"]
        if settled:
            return reached


def _share(pages: DataFrame, verdict: str) -> DataFrame:
    mine = pages.where((F.col("ruled") == verdict) & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"))
    total = mine.agg(F.sum("n").alias("total"))
    n = total.collect()[0]["total"] or 1
    return mine.select(F.col("host").alias("node"), (F.col("n") / F.lit(float(n))).alias("seed"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust of every page."""
    host, path = host_path(F.col(url))
    df = pages.select(F.col(key), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    name, ruled = compile_rules(rules)
    df = df.withColumns({"rule": name, "ruled": ruled})
    links = durable(host_links(df))
    out = df.select(key, "host", "path", "rule", "ruled")
    if links.isEmpty():
        # without a link nothing reaches any host
        return out.select(key, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    trust = propagate(links, _share(df, "allow"))
    distrust = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), _share(df, "block"))
    score = trust.select("node", F.col("reached").alias("trust"), F.lit(0.0).alias("distrust")).unionAll(distrust.select("node", F.lit(0.0).alias("trust"), F.col("reached").alias("distrust")))
    score = durable(score.groupBy(F.col("node").alias("host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    out = out.join(score, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= BLOCK_SHARE * (F.col("trust") + F.col("distrust")))
    return out.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
