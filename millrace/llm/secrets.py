"""Operator 10, secret scans: candidate strings judged by a random forest.

A candidate is a maximal run of at least MIN_LENGTH characters of the base64 and URL alphabets with a
digit in it; or, digit or not, a run that begins as the keys of a well-known service do; or the value
assigned (= or :) to a name that says secret, of MIN_ASSIGNED characters other than space and quote or
more. Of those that begin at one place the assigned value is taken, and it takes in runs within it. Its
features: length; shares of kinds of characters; transitions, that is what share of its neighbouring
characters goes from each kind (digit, upper, lower, other) to each other one; distinct characters; how
much of it the corpus's dictionary covers (its letter runs that are among the DICTIONARY most frequent
words); what the path says (test, example, ...); and the words and signs on both sides of it, three words
each: whether they name a secret, an identifier or a placeholder, and how many of them the dictionary
holds. The forest is trained on labelled findings, at most MAX_FINDINGS of them, and removes false
positives. Without labelled findings of one's own, `labelled_findings` makes a fixed set by rule, in which
secrets and others share the same forms, names and places with different frequency, so that no one sign
decides.

All of it is SQL expressions, aggregations, joins and Spark's own forest. The dictionary is counted
over all documents: a histogram of the counts gives the count from which words enter, so that no task
sorts more than the words of one count; of it at most DICTIONARY words are broadcast.

Nulls and odd input: a null text has no candidate, a null path says nothing. Repeated rows give repeated
findings. Words of equal frequency enter the dictionary in alphabetic order. Long texts and candidates are
read whole, and the words beside a candidate however long they are. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import durable, let
from millrace.llm.spans import matches, substrings

MIN_LENGTH = 16
MIN_ASSIGNED = 6
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}+" % MIN_LENGTH
DICTIONARY = 5000
MAX_FINDINGS = 20_000
REACH = 256
TREES, DEPTH, SEED = 30, 7, 10
#: Kinds of characters, and how many words on each side are looked at.
CLASSES = "dulo"
NEAR = 3
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "distinct", "hex", "coverage", "odd_path", "keyword", "assigned", "quoted", "placeholder", "numeric", "known_prefix",
    "identifier", "keyword_after", "near_known", *(f"from_{x}_{y}" for x in CLASSES for y in CLASSES),
)

#: Words before a secret, words of a placeholder, words of a path that holds no live secret.
KEYWORDS = r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credential|private[_-]?key|auth)"
IDENTIFIERS = r"(?i)(commit|sha-?(1|256)|md5|uuid|checksum|hash|digest|order|invoice|isbn|build|page|card|number|version|revision)"
PLACEHOLDERS = r"(?i)(example|dummy|sample|placeholder|changeme|test|your[_-]|x{6,}|0{8,}|1234567)"
ODD_PATHS = r"(?i)(test|example|sample|mock|fixture|docs?/)"
#: How keys of well-known services begin.
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|rk_live_|AIza|glpat-)"


#: A value that follows a keyword and an assignment, and a key by its prefix.
ASSIGNED = r"(?i)(?<=(?:%s)[A-Za-z0-9_-]{0,16}[\"']?\s{0,4}[=:]\s{0,4}[\"']?)(?<![^\s=:\"'])[^\s\"'=:,;][^\s\"']{%d,}+" % (KEYWORDS.removeprefix("(?i)"), MIN_ASSIGNED - 1)
PREFIXED = r"(?<![A-Za-z0-9+/_-])" + PREFIXES.removeprefix("^") + r"[A-Za-z0-9+/_-]{%d,}+" % MIN_ASSIGNED


def _candidates(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # a plain search first, as most texts hold nothing
    runs = F.when(text.rlike("[A-Za-z0-9+/_-]{%d}" % MIN_LENGTH), F.filter(matches(text, CANDIDATE), lambda m: m["value"].rlike("[0-9]"))).otherwise(none)
    named = F.when(text.rlike(KEYWORDS), matches(text, ASSIGNED)).otherwise(none)
    known = F.when(text.rlike(PREFIXES.removeprefix("^")), matches(text, PREFIXED)).otherwise(none)
    within = lambda m, held: F.exists(held, lambda o: (o["start"] <= m["start"]) & (m["end"] <= o["end"]))
    return let(named, lambda a: let(F.filter(F.array_distinct(F.concat(runs, known)), lambda m: ~within(m, a)), lambda b: F.array_sort(F.concat(a, b))))


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """key, start, end, value, before (the characters before it), after, path of every candidate."""
    t = F.coalesce(F.col(text), F.lit(""))
    given = documents.select(F.col(key), t.alias("_text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    found = _candidates(F.col("_text"))
    placed = given.select(F.col(key), "path", F.explode(let(found, lambda ms: F.when(F.size(ms) > 0, _with_neighbours(F.col("_text"), ms)))).alias("_m"))
    return placed.select(key, "_m.start", "_m.end", "_m.value", "_m.before", "_m.after", "path")


def _with_neighbours(text: Column, ms: Column) -> Column:
    """Matches with NEAR words on each side and what stands between: cut from REACH characters if these hold so many, from all of the text if not."""
    left = F.transform(ms, lambda m: F.struct(F.greatest(m["start"] - REACH, F.lit(0)).alias("start"), m["start"].alias("end")))
    right = F.transform(ms, lambda m: F.struct(m["end"].alias("start"), F.least(m["end"] + REACH, F.length(text)).alias("end")))
    enough = lambda side: F.regexp_count(side, F.lit(" ")) > NEAR

    def placed(m: Column, sides: Column) -> Column:
        before = F.when((m["start"] <= REACH) | enough(sides["l"]), sides["l"]).otherwise(F.substring(text, F.lit(1), m["start"]))
        after = F.when((m["end"] + REACH >= F.length(text)) | enough(sides["r"]), sides["r"]).otherwise(F.substring(text, m["end"] + 1, F.length(text)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.substring_index(before, " ", -NEAR - 1).alias("before"), F.substring_index(after, " ", NEAR + 1).alias("after"))

    sides = F.zip_with(substrings(text, left), substrings(text, right), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return F.zip_with(ms, sides, placed)


def dictionary(documents: DataFrame, text: str = "text", size: int = DICTIONARY) -> DataFrame:
    """word: the most frequent words of three letters and more."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}+"), F.lit(0))).alias("word"))
    counts = durable(words.groupBy("word").agg(F.count("*").alias("n")))
    # counts by power of two, then by the quarter, and so on, until few words share the last count that is let in: a row a bucket
    low, high, above = 1, (counts.agg(F.max("n")).first()[0] or 1) + 1, 0
    while high - low > 1:
        step = max(1, (high - low) // 256)
        buckets = counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(F.floor((F.col("n") - low) / step).alias("k")).agg(F.count("*").alias("m")).orderBy(F.desc("k")).collect()  # 512 rows at most
        for r in buckets:
            if above + r["m"] >= size:
                low, high = low + r["k"] * step, min(high, low + (r["k"] + 1) * step)
                break
            above += r["m"]
        else:
            low, high = low, low + 1  # fewer words than asked for
    # words of the last count fill what is left in alphabetic order
    ties = counts.where(F.col("n") == low).select("word").orderBy("word").limit(size - above)
    return durable(counts.where(F.col("n") >= high).select("word").unionAll(ties))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found (value, before, after, path, and more) with the columns of FEATURES. words: at most DICTIONARY rows."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    # every character as the letter of its kind; a transition of two kinds is a pair of neighbours, counted by what is missing without it
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "o")
    pairs = F.greatest(n - 1, F.lit(1))
    moves = {f"from_{x}_{y}": F.regexp_count(F.col("_kinds"), F.lit(f"{x}(?={y})")) / pairs for x in CLASSES for y in CLASSES}
    before, after = F.col("before"), F.col("after")
    df = found.withColumns(
        {
            "length": n.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "_kinds": kinds,
            "odd_path": flag(F.col("path").rlike(ODD_PATHS)), "keyword": flag(before.rlike(KEYWORDS)), "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
            "quoted": flag(before.rlike(r"[\"']$")), "placeholder": flag(v.rlike(PLACEHOLDERS) | before.rlike(PLACEHOLDERS) | after.rlike(PLACEHOLDERS)), "numeric": flag(v.rlike("^[0-9-]+$")), "known_prefix": flag(v.rlike(PREFIXES)),
            "identifier": flag(before.rlike(IDENTIFIERS)), "keyword_after": flag(after.rlike(KEYWORDS)),
        }
    ).withColumns(moves).drop("_kinds")
    # the letter runs of each distinct value, and of each distinct surrounding, against the dictionary
    beside = F.concat_ws(" ", before, after)
    df = df.withColumn("_beside", beside)
    runs = lambda c, pattern: F.explode(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))).alias("word")
    covered = df.select("value").distinct().select("value", runs("value", "[a-z]{3,}+")).join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("_covered"))
    known = df.select("_beside").distinct().select("_beside", runs("_beside", r"\p{L}{3,}+")).join(F.broadcast(words), "word").groupBy("_beside").agg(F.count("*").alias("_known"))
    df = df.join(covered, "value", "left").withColumn("coverage", F.coalesce(F.col("_covered") / F.col("length"), F.lit(0.0))).drop("_covered")
    return df.join(known, "_beside", "left").withColumn("near_known", F.coalesce(F.col("_known").cast("double"), F.lit(0.0))).drop("_known", "_beside")


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n findings with label (1: secret), made by rule from hashes: keys, passwords and tokens; numbers, names, digests of content, placeholders."""
    r = lambda k, m: F.pmod(F.xxhash64(F.lit(SEED), F.lit(k), "id"), F.lit(m))
    pick = lambda k, *of: F.get(F.array(*[F.lit(x) for x in of]), r(k, len(of)).cast("int"))
    noise = F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256)
    other = F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(noise)), "[+/=]", "x")
    upper = F.translate(F.upper(noise), "018", "GKZ")
    secret = (
        F.when(r(1, 5) == 0, F.concat(pick(2, "AKIA", "ASIA"), F.substring(upper, 1, 16)))
        .when(r(1, 5) == 1, F.substring(noise, 1, 40))
        .when(r(1, 5) == 2, F.concat(F.substring(noise, 1, 8), F.substring(other, 1, 10)))
        .when(r(1, 5) == 3, F.concat(pick(3, "ghp_", "sk_live_", ""), F.substring(mixed, 1, 36)))
        .otherwise(F.substring(mixed, 1, 24))
    )
    word = pick(4, "the", "and", "der", "que", "with", "that", "version", "report")
    plain = (
        F.when(r(5, 7) == 0, F.rpad(F.translate(F.substring(noise, 1, 16), "abcdef", "123456"), 16, "7"))
        .when(r(5, 7) == 1, F.concat(word, F.lit("-"), pick(6, "from", "for", "this", "und"), F.lit("-"), word, F.lit("-"), (r(7, 89) + 10).cast("string"), F.lit("-and")))
        .when(r(5, 7) == 2, F.substring(noise, 1, 40))
        .when(r(5, 7) == 3, F.concat(pick(8, "AKIA", "sk_live_", ""), F.lit("EXAMPLE0EXAMPLE00"), F.substring(upper, 1, 2)))
        .when(r(5, 7) == 4, F.concat(F.substring(noise, 1, 8), F.lit("-"), F.substring(noise, 9, 4), F.lit("-4"), F.substring(noise, 13, 3), F.lit("-a"), F.substring(noise, 16, 3), F.lit("-"), F.substring(noise, 19, 12)))
        .when(r(5, 7) == 5, F.substring(mixed, 1, 32))
        .otherwise(F.concat(F.lit("2024-0"), (r(9, 9) + 1).cast("string"), F.lit("-1"), r(10, 9).cast("string"), F.lit("-"), word, F.lit("-"), word))
    )
    label = (F.col("id") % 2).cast("double")
    # the same names and signs stand before both, secrets being named as such far more often; a key by its prefix may stand anywhere
    named = F.when(label == 1, (r(1, 5) == 0) & (r(11, 2) == 0) | (r(11, 20) > 1)).otherwise((r(5, 7) == 3) | (r(5, 7) == 1) & (r(11, 2) == 0) | (r(11, 20) == 0))
    name = pick(14, "password", "token", "api_key", "secret", "passwd", "auth", "client_secret")
    other_name = pick(17, "commit ", "order ", "see ", "id: ", "sha256:", "page ", "checksum = ", "build: ", "", "and then ")
    lead = pick(13, "some words ", "", "line\n", "more of it in ", "the ")
    before = F.when(named, F.concat(lead, name, pick(15, "=", ' = "', ": ", "='"))).otherwise(F.concat(lead, other_name))
    after = pick(19, " and so on", '" the', "\n", "", " of it", "' with password set", " is an example", " token")
    after = F.when((label == 1) & after.contains("example"), F.lit(" and so on")).otherwise(after)
    path = F.when((label == 1) & (r(21, 10) > 0), pick(18, "src/main", "conf/prod", "src0", "app")).otherwise(pick(18, "src/main", "tests/data", "src0", "docs/page"))
    return spark.range(n).select(F.col("id"), F.when(label == 1, secret).otherwise(plain).alias("value"), before.alias("before"), after.alias("after"), path.alias("path"), label.alias("label"))


def train(findings: DataFrame, words: DataFrame) -> RandomForestClassificationModel:
    """findings: value, before, after, path, label (0 or 1). At most MAX_FINDINGS of them are used, by the hash of their values."""
    some = findings.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(MAX_FINDINGS)
    rows = durable(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(some, words)).select("features", "label"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def scan(documents: DataFrame, model: RandomForestClassificationModel, words: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """key, start, end, value, score, is_secret of every candidate."""
    found = features(durable(candidates(documents, key, text, path)), words)  # read once for itself and once for each of its dictionaries
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return judged.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", F.round(score, 6).alias("score"), (score >= 0.5).alias("is_secret"))
