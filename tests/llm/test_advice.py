"""What the operators did less than wholly before the advice of round 1."""

import itertools
import random

import pytest

from millrace.llm import pii, resemblance, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("small", [32, 1])
def test_near_dedup_by_resemblance(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(None, "a b c d e f"), (5000, None), (5001, ""), (5002, "a b c"), (5003, "A b\nc")], docs.schema))
    sets = {r.doc_id: set(resemblance.shingles(r.text).tolist()) for r in docs.collect() if r.doc_id is not None}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs, small=small).collect()}
    assert got.pop(None) is None and got == {k: top(k) for k in sets}
    assert resemblance.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert 1 in left and 177 not in left  # similarity 0.83, more than 4 bits apart
    assert 177 in {r.doc_id for r in simhash.deduplicate(docs).collect()}


def test_pipeline_drops_unlearnt_languages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    russian = "Жили были дед и баба и была у них курочка ряба. " * 9
    finnish = "Vanhan miehen talo oli metsän reunassa ja hän käveli sinne joka päivä aamulla varhain, kun aurinko nousi järven yli. Illalla hän palasi kotiin ja keitti kahvia ystävilleen. "
    more = spark.createDataFrame([(9001, russian), (9002, finnish), (9003, finnish * 5), (9004, "12 34")], "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(more, allowMissingColumns=True), SF).collect()}
    assert left == {r.doc_id for r in docs.collect()}


def letters(n, line, seed=3):
    """n texts of random words, each with the line in it."""
    rnd = random.Random(seed)
    words = [a + b + c for a in ("bar", "lon", "mis", "tev", "gar") for b in ("a", "e", "i", "o") for c in ("nt", "rd", "sk", "lm", "pt")]
    some = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    return [f"{some(12)} {line} {some(12)}" for _ in range(n)], [some(25) for _ in range(200)]


def test_pii_few_texts_and_signatures(spark):
    held, rest = letters(3, "yours Kowalska kowal@corp.example in Leeds")
    sanitised = [r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(held + rest)), "doc_id long, text string")).collect()]
    assert not any("Kowalska" in t for t in sanitised)
    edited = [held[0], held[0] + " barant", "lonard " + held[0]]  # copies of one text prove nothing
    sanitised = [r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(edited + rest)), "doc_id long, text string")).collect()]
    assert sum("Kowalska" in t for t in sanitised) == 3


def test_pii_terms_far_from_the_value(spark):
    held, rest = letters(4, "kowal@corp.example")
    held = ["Kowalska " + t for t in held]  # twelve words before the value
    sanitised = [r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(held + rest)), "doc_id long, text string")).collect()]
    assert not any("Kowalska" in t for t in sanitised) and sum("<EMAIL>" in t for t in sanitised) == 4


def test_secrets_short_broken_and_without_digits(spark):
    text = "password=hunter2x and db_password: 'p@ss!w0rd#x.y' or token = abcdEFGHijklMNOPqrst ghp_abcdefghijKLMNOPqrstuvwxyzABCDEFghij end"
    rows = [(1, text, "src"), (2, "no password here", "src"), (3, None, None)]
    got = [(r.doc_id, r.value) for r in secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id", "start").collect()]
    assert got == [(1, "hunter2x"), (1, "p@ss!w0rd#x.y"), (1, "abcdEFGHijklMNOPqrst"), (1, "ghp_abcdefghijKLMNOPqrstuvwxyzABCDEFghij")]
