"""Operator 2, personal data: fixed patterns, then information-theoretic sanitisation.

The values that the patterns find (e-mail addresses, IP addresses, card and telephone numbers) are the
protected entities, and so are the groups that they belong to (mail domain, address block, card issuer,
dialling code), as a value may be too rare for any count to tell. The words of the texts that hold them are candidate terms. Over the whole corpus, counted by distinct text,
IC(e) = -log2 p(e) is an entity's information and PMI(e, t) = log2 p(e, t) / (p(e) p(t)) what a term
tells of it; a term with PMI >= IC / ALPHA discloses the entity. It is removed where it tells all
(PMI >= REMOVE * IC) and generalised to its entity's kind otherwise. Every observed pair is judged, and
must be more than chance makes among all pairs (Bonferroni, LEVEL); no count of texts is asked for beyond
that. Texts of entities that are copies of each other, edited or not, count once, so that copies of one
text prove nothing. Disclosing terms are found wherever they stand in the corpus.

Everything is SQL expressions, aggregations and joins. Pairs are aggregated before they are shuffled.
Candidate terms are broadcast, and disclosing terms looked up in one value, only up to BROADCAST_TERMS of
them (counted); beyond, the words of the corpus are joined to them by a shuffle.

Nulls and odd input: a null text counts as empty, has no span and stays null when sanitised. Repeated
texts count once. Ties do not arise: spans are ordered by start, kind and
end. Extra columns pass through `sanitise` and are ignored by `find`. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, durable, let
from millrace.llm.simhash import components
from millrace.llm.spans import matches, running, substrings

#: The kinds in the order that breaks ties, with their patterns. They match what the
#: plain forms match; possessive repeats and the tests on what precedes keep them linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ALPHA = 1.1
REMOVE = 0.999
LEVEL = 0.05
#: Texts of entities that are so similar (five-word shingles) are copies.
COPY = 0.5
BANDS = 16
BROADCAST_TERMS = 100_000
TERM = r"\p{L}{3,}+"
TERM_KIND = len(KINDS)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans_of(text: Column, k: int) -> Column:
    valid = F.filter(matches(text, PATTERNS[KINDS[k]]), lambda m: _valid(KINDS[k], m["value"]))
    return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the patterns' valid matches, sorted; kind is the place in KINDS."""
    found = []
    for k, kind in enumerate(KINDS):
        mark = {"email": "@", "phone": "+", "ip": ".", "card": ""}[kind]
        some = F.contains(text, F.lit(mark)) if mark else F.lit(True)
        found.append(F.when(some, _spans_of(text, k)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))
    return F.when(text.rlike("[0-9@]"), F.sort_array(F.concat(*found))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _tells(total: int, tested: int, n_entity: Column, n_term: Column, n_both: Column) -> tuple[Column, Column, Column]:
    """IC, PMI and whether a term discloses: PMI reaches its threshold, and chance makes n_both or more in none of the tested pairs with confidence 1 - LEVEL.

    Chance is bounded by exp(-n KL), Hoeffding's bound for draws without replacement. Both conditions only weaken as n_term grows.
    """
    n = F.lit(float(total))
    ic, pmi = F.log2(n / n_entity), F.log2(n * n_both / (n_entity * n_term))
    a, q = n_both / n_entity, F.least(n_term / n, F.lit(1.0))
    apart = a * F.log(a / q) + F.when((a < 1) & (q < 1), (1 - a) * F.log((1 - a) / (1 - q))).otherwise(0.0)
    sure = F.log(F.lit(float(tested))) - n_entity * apart <= math.log(LEVEL)
    return ic, pmi, (ic > 0) & (pmi >= ic / ALPHA - 1e-9) & sure


def _group(span: Column) -> Column:
    """The group of a value, written so that it equals no value: a domain, an address block of 256, an issuer, a dialling code."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    of = [F.regexp_extract(span["value"], "@.*", 0), F.regexp_extract(span["value"], r"^(?:[0-9]+\.){3}", 0), F.substring(digits, 1, 6), F.concat(F.lit("+"), F.substring(digits, 1, 4))]
    return F.concat(F.lit("group "), F.get(F.array(*of), span["kind"]))


def _copies(texts: DataFrame) -> DataFrame:
    """d, g of texts (d, _text): equal g for texts that are copies. Texts are judged with the first of those that share one of BANDS pairs of minimum hashes of five-word shingles, never all with all."""
    words = F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0))
    shingles = let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(5)), " ")))))
    sets = durable(texts.select("d", shingles.alias("held")))
    # an order for each hash: the shingles' hashes under masks, no two of which begin with the same bits
    masks = [(k << 59 | 0x5851F42D4C957F2D * (2 * k + 1) % (1 << 59)) for k in range(2 * BANDS)]
    under = lambda m: F.array_min(F.transform("held", lambda h: h.bitwiseXOR(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long"))))
    least = [under(m) for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(k), least[2 * k], least[2 * k + 1]) for k in range(BANDS)])
    keyed = durable(sets.select("d", F.explode(keys).alias("key")))
    first = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "d").alias("h"), F.col("d").alias("a"))).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f.a")
    pairs = keyed.join(first, "key").where("a <> d").select("a", F.col("d").alias("b")).distinct()
    left, right = sets.select(F.col("d").alias("a"), F.col("held").alias("x")), sets.select(F.col("d").alias("b"), F.col("held").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").join(right, "b").where(both >= COPY * (F.size("x") + F.size("y") - both)).select("a", "b")
    roots = components(near).select(F.col("node").alias("d"), F.col("root"))
    return durable(sets.select("d").join(roots, "d", "left").select("d", F.coalesce("root", "d").alias("g")))


def disclosing(found: DataFrame) -> DataFrame:
    """term, kind, removed: the terms that disclose an entity, each with the kind that it tells most of.

    found: rows with _text and base, an array of base_spans().
    """
    spark = found.sparkSession
    schema = "term string, kind int, removed boolean"
    # an entity is a string, its kind first: equal strings are found by hash, equal structs by comparing all with all
    entities = F.array_distinct(F.flatten(F.transform("base", lambda s: F.array(F.concat(s["kind"].cast("string"), s["value"]), F.concat(s["kind"].cast("string"), _group(s))))))
    holding = found.where(F.size("base") > 0).select(F.xxhash64("_text").alias("d"), F.struct("_text", entities.alias("entities"), F.array_distinct(_terms(F.regexp_replace("_text", PATTERNS["email"], " "))).alias("terms")).alias("x"))
    holding = durable(holding.groupBy("d").agg(F.first("x").alias("x")).select("d", "x.*"))
    if holding.isEmpty():
        return spark.createDataFrame([], schema)
    # texts that are copies of each other, edited or not, are one piece of evidence, g
    copies = _copies(holding)
    counted = copies.agg(F.count("*").alias("d"), F.count_distinct("g").alias("g")).first()
    total = found.agg(F.count_distinct(F.xxhash64("_text"))).first()[0] - counted["d"] + counted["g"]
    held = holding.join(copies, "d").select("g", "entities", "terms")
    tested = held.agg(F.sum(F.size("entities") * F.size("terms"))).first()[0] or 1
    of_entity = held.select("g", F.explode("entities").alias("entity"), "terms")
    entity_docs = of_entity.select("g", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    # entities in so few texts that no term could be told from chance, and then terms that are too common in the texts of
    # any entity (a part of those that hold the term), leave before the corpus is searched; neither changes the result
    open_ = entity_docs.where(_tells(total, tested, F.col("n_entity"), F.col("n_entity"), F.col("n_entity"))[2])
    pairs = of_entity.join(open_, "entity").select("g", "entity", "n_entity", F.explode("terms").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both"))
    pairs = durable(pairs.where(_tells(total, tested, F.col("n_entity"), F.col("n_both"), F.col("n_both"))[2]))
    near = held.select("g", F.explode("terms").alias("term")).join(pairs.select("term").distinct(), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    support = durable(pairs.join(near, "term").where(_tells(total, tested, F.col("n_entity"), F.col("n_near"), F.col("n_both"))[2]))
    if support.isEmpty():
        return spark.createDataFrame([], schema)
    # texts that hold the term
    candidates = durable(support.select("term").distinct())
    n = candidates.count()
    small = F.broadcast(candidates) if n <= BROADCAST_TERMS else candidates
    texts = found.select(F.xxhash64("_text").alias("d"), F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term")).join(small, "term", "left_semi").distinct()
    term_docs = texts.join(copies, "d", "left").select("term", F.coalesce("g", "d").alias("g")).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    ic, pmi, told = _tells(total, tested, F.col("n_entity"), F.col("n_term"), F.col("n_both"))
    best = support.join(term_docs, "term").where(told).groupBy("term").agg(F.min(F.struct((-pmi / ic).alias("told"), F.substring("entity", 1, 1).cast("int").alias("kind"))).alias("b"))
    return durable(best.select("term", F.col("b.kind").alias("kind"), (F.col("b.told") <= -REMOVE).alias("removed")))


def _slots(terms: DataFrame, n: int) -> Column:
    """The n terms (term, kind, removed) as a hash table in one value: a scalar subquery, an array with a list for each of n slots."""
    lists = terms.groupBy(_slot(F.col("term"), n).alias("id")).agg(F.collect_list(F.struct("term", "kind", "removed")).alias("held"))
    every = terms.sparkSession.range(n).select(F.col("id").cast("int").alias("id")).join(lists, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "held"))), lambda x: x["held"])).scalar()


def _slot(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def _told(text: Column, slots: Column, n: int) -> Column:
    """Those of the terms in slots that text holds, null if none; texts need no shuffle for it."""
    none = F.array().cast("array<struct<term:string,kind:int,removed:boolean>>")
    of_word = lambda w: F.coalesce(F.filter(F.get(slots, _slot(w, n)), lambda t: t["term"] == w), none)
    return let(F.flatten(F.transform(F.array_distinct(_terms(text)), of_word)), lambda t: F.when(F.size(t) > 0, t))


def _without_overlaps(spans: Column) -> Column:
    """Sorted spans without the terms that overlap a base span: one that begins before them and ends within or after, or one that begins within them."""
    base = lambda s, value, other: F.when(s["kind"] < TERM_KIND, value.cast("long")).otherwise(F.lit(other).cast("long"))
    upto = running(F.transform(spans, lambda s: base(s, s["end"], 0)), lambda a, x: F.greatest(a, x))
    after = F.reverse(running(F.reverse(F.transform(spans, lambda s: base(s, s["start"], 1 << 40))), lambda a, x: F.least(a, x)))
    return let(upto, lambda u: let(after, lambda d: F.filter(spans, lambda s, k: (s["kind"] < TERM_KIND) | ((F.get(u, k) <= s["start"]) & (F.get(d, k) >= s["end"])))))


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """key (and columns), _text (null as empty), base, and spans: base and term spans, sorted; a term's value is its replacement."""
    given = documents.select(key, *columns, F.col(text).alias("_given"), F.coalesce(text, F.lit("")).alias("_text"))
    with_base = given.withColumn("base", base_spans(F.col("_text")))
    terms = disclosing(with_base.select("_text", "base"))
    n = terms.count()
    if not n:
        return with_base.withColumn("spans", F.col("base"))
    if n <= BROADCAST_TERMS:
        # slots is used once, so the optimizer puts the subquery in its place and no row carries it
        joined_up = with_base.withColumn("slots", _slots(terms, n)).withColumn("told", _told(F.col("_text"), F.col("slots"), n)).drop("slots")
    else:
        told = with_base.select(F.xxhash64("_text").alias("_a"), F.md5("_text").alias("_b"), F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term")).join(terms, "term")
        told = told.groupBy("_a", "_b").agg(F.collect_set(F.struct("term", "kind", "removed")).alias("told"))  # at most the words of one text
        joined_up = with_base.withColumns({"_a": F.xxhash64("_text"), "_b": F.md5("_text")}).join(told, ["_a", "_b"], "left").drop("_a", "_b")
    names = F.array(*[F.lit(k) for k in KINDS])
    words = matches(F.col("_text"), r"\p{L}{3,}+")
    hits = F.transform(
        words,
        lambda w: F.struct(
            w["start"].alias("start"),
            F.lit(TERM_KIND).alias("kind"),
            w["end"].alias("end"),
            let(F.filter("told", lambda t: t["term"] == F.lower(w["value"])), lambda t: F.when(F.size(t) == 0, F.lit(None)).when(F.get(t, F.lit(0))["removed"], F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(F.get(names, F.get(t, F.lit(0))["kind"])), F.lit("-RELATED>")))).alias("value"),
        ),
    )
    # in steps, as the analyzer resolves one level of nested functions at a time; texts without a term take none of them
    some = F.col("told").isNotNull()
    joined_up = joined_up.withColumn("hits", F.when(some, F.filter(hits, lambda h: h["value"].isNotNull())))
    joined_up = joined_up.withColumn("hits", F.when(some, F.sort_array(F.concat("base", "hits"))))
    return joined_up.withColumn("spans", F.when(some, _without_overlaps(F.col("hits"))).otherwise(F.col("base"))).drop("told", "hits")


def replaced(text: Column, spans: Column) -> Column:
    """text with its spans (sorted, at least one) replaced: <KIND> for a base span, its own replacement for a term; what overlaps is replaced once, as its first span."""
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    put = lambda s: F.when(s["kind"] == TERM_KIND, s["value"]).otherwise(F.get(labels, s["kind"]))
    reach = running(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, x: F.greatest(a, x))

    def built(upto: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(upto, k - 1))
        placed = F.transform(spans, lambda s, k: F.struct(before(k).alias("start"), s["start"].cast("long").alias("end"), put(s).alias("put")))
        first = F.filter(placed, lambda p: p["end"] >= p["start"])
        tail = F.substring(text, (F.element_at(upto, -1) + 1).cast("int"), F.length(text))
        joined_up = lambda f: F.array_join(F.zip_with(substrings(text, f), f, lambda gap, p: F.concat(gap, p["put"])), "")
        return F.concat(let(first, joined_up), tail)

    return let(reach, built)


def sanitise(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents, with all their columns, their texts without what is personal."""
    others = [c for c in documents.columns if c not in (key, text)]
    kept = F.struct(*others) if others else F.struct(F.lit(0))
    found = find(documents.select(key, text, kept.alias("_others")), key, text, ("_others",))
    new = F.when(F.size("spans") > 0, replaced(F.col("_text"), F.col("spans"))).otherwise(F.col("_given"))
    return found.select(*[new.alias(c) if c == text else F.col(c) if c == key else F.col("_others")[c].alias(c) for c in documents.columns])


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the number of base spans by kind, base_sha256, spans."""
    found = find(documents, key, text)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
