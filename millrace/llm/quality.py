"""Operator 1, quality rules: a table of thresholds compiled into one Spark projection.

Every measure is an SQL expression over the whole text; there is no user function and no shuffle, so
the plan is one scan and one projection however large the corpus is. Repeated three-word windows are
found by sorting packed window hashes within the row (linearithmic in its words) and then confirmed on
the words themselves, so that a hash collision never counts.

Nulls and odd input: a null text counts as empty; an empty text has zero counts and fails the base
rule. Repeated rows give repeated results. Extra columns are ignored; only doc_id and the measures
leave the operator. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from have he in is it not of on or that the this to was with "
    "als auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec ce dans de des du elle en est et il la le les par pas plus pour que qui sur un une "
    "al como con del el es la las lo los no para por que se su un una y"
).split()

#: Bits of a packed window that hold its position; the rest holds the hash.
POSITION_BITS = 30


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a bound of None does not bind."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Shares are of words or of lines that hold a word.
RULES = (
    Rule("mean_word_length", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.02),
    Rule("alphabetic_ratio", low=0.6),
    Rule("duplicate_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
)


def _repeat_words(words: str) -> tuple[Column, Column, Column]:
    """Expressions over earlier columns: packed and sorted windows; the candidates of `packed`; the words covered."""
    w = F.col(words)
    mask = (1 << (63 - POSITION_BITS)) - 1

    def pack(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda x, i: F.shiftleft(F.xxhash64(x, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(F.lit(mask)), POSITION_BITS).bitwiseOR(i.cast("long")),
        )

    packed = F.sort_array(let(w, pack))

    def repeated(sorted_windows: Column) -> Column:
        high = lambda x: F.shiftright(x, POSITION_BITS)
        return F.filter(
            sorted_windows,
            lambda x, i: F.coalesce(high(x) == high(F.get(sorted_windows, i + 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(sorted_windows, i - 1)), F.lit(False)),
        )

    candidates = let(F.col("_packed"), repeated)

    def exact(ws: Column) -> Column:
        windows = F.transform(
            F.col("_candidates"),
            lambda x: let(
                x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"),
                lambda p: F.struct(F.concat_ws(" ", F.get(ws, p), F.get(ws, p + 1), F.get(ws, p + 2)).alias("t"), p.alias("p")),
            ),
        )
        return let(
            F.sort_array(windows),
            lambda s: F.transform(
                F.filter(s, lambda x, i: F.coalesce(x["t"] == F.get(s, i + 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(s, i - 1)["t"], F.lit(False))),
                lambda x: x["p"],
            ),
        )

    covered = F.aggregate(
        F.sort_array(let(w, exact)),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return packed, candidates, F.when(F.size("_candidates") > 0, covered).otherwise(F.lit(0).cast("long"))


def measures(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: the counts that the base rule uses and every measure that RULES may name."""
    given = F.coalesce(F.col(text), F.lit(""))
    df = documents.select(F.col(key), given.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    has_word = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    packed, candidates, covered = _repeat_words("_words")
    df = df.withColumns({"_packed": packed, "_lines": has_word}).withColumn("_candidates", candidates)
    long = lambda c: c.cast("long")
    df = df.select(
        key,
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.translate("_text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size(F.filter("_words", lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(STOP_WORDS)))).alias("n_stop_words"),
        long(F.size(F.filter("_words", lambda x: x.rlike(r"\p{L}")))).alias("n_alphabetic"),
        long(F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))).alias("n_ellipsis_lines"),
        long(F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•‣▪]")))).alias("n_bullet_lines"),
    )
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_word_length": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "stop_word_ratio": share("n_stop_words", "n_words"),
            "alphabetic_ratio": share("n_alphabetic", "n_words"),
            "duplicate_line_ratio": share("n_dup_lines", "n_lines"),
            "ellipsis_line_ratio": share("n_ellipsis_lines", "n_lines"),
            "bullet_line_ratio": share("n_bullet_lines", "n_lines"),
        }
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures() breaks, as one expression."""
    broken = []
    for r in rules:
        c = F.col(r.measure)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (c < F.lit(r.low))
        if r.high is not None:
            bad = bad | (c > F.lit(r.high))
        broken.append(F.when(bad, F.lit(r.measure)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """measures() with base_failed, broken_rules and kept."""
    df = measures(documents, text, key)
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "broken_rules": compile_rules(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
