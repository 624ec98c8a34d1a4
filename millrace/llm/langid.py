"""Operator 6, language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three letters, words padded with a space) by
rank. A document is given the language whose profile has the least out-of-place distance from the
document's own: the sum of the rank differences of the document's n-grams, an n-gram that the profile
lacks counting as the profile's length.

Learning reads labelled rows only, and all of them, whole: profiles are made from the counts of every
n-gram of every labelled text, the bound on distance from the scores of every labelled text that is
given its own language. Predictions use nothing but the text, the whole of it.

Nulls and odd input: a null text, or one without a letter, is `und` with score 0; ties between
languages go to the smaller name. Repeated rows give repeated results; extra columns are ignored, and
the operator needs none beyond those it names. Without any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.stats import percentile_by_index
from millrace.llm.common import bounded_batches, pieces

PROFILE = 300
SPACE = 32
#: A score below SLACK of that which all but UNLIKE of a language's labelled rows reach speaks for no learnt language.
SLACK, UNLIKE = 0.85, 0.001
#: Scores are counted in steps of 1 / STEPS, so a language has at most STEPS + 1 rows however many texts it has.
STEPS = 10_000
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """The packed n-grams of a text, 21 bits a code point; a run of other characters is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    codes = np.where(is_letter, codes, SPACE).astype(np.int64)
    keep = np.ones(len(codes), dtype=bool)
    keep[0] = is_letter[0]
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = codes[keep]
    codes = np.concatenate(([SPACE], codes[:-1] if codes[-1] == SPACE else codes, [SPACE]))
    one, two = codes[codes != SPACE], (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    two = two[two != (SPACE << 21 | SPACE)]
    return np.concatenate((one, two, three))


def profile(grams: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, the most frequent first, ties by code."""
    grams, counts = np.unique(grams, return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:length]]


class Profiles:
    """Ranks of all languages by n-gram."""

    def __init__(self, ranked: dict[str, list[int]], length: int):
        self.names, self.length = sorted(ranked), length
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.int64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(self.grams, np.array(ranked[name], dtype=np.int64))] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(ngrams(text), self.length) if text else []
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.length * len(own)))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", length: int = PROFILE) -> Profiles:
    """Profiles of the languages of `labelled`, from all its rows that have a text and a language."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where("_lang is not null and _text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            by: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                by.setdefault(name, []).append(ngrams(t))
            for name, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):  # length rows a language
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, length)


def least_score(labelled: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> float:
    """The score below which a text is in none of the learnt languages, from the scores of all labelled rows that are given their own, rounded down to 1 / STEPS; 0 without any."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("_lang")).where("_lang is not null and text is not null")
    right = identify(rows, profiles).where("lang_pred = _lang").select("_lang", F.floor(F.col("score") * STEPS).alias("step"))
    low = [r["low"] for r in percentile_by_index(right, ["_lang"], "step", {"low": f"ceil({UNLIKE} * n) - 1"}).collect()]  # a row for each language
    return SLACK * min(low) / STEPS if low else 0.0


def identify(documents: DataFrame, profiles: Profiles, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents with two more columns; what else they hold passes unread."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([f for f in documents.schema.fields if f.name not in into] + [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    keep = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in pieces(batches):
            found = [p.predict(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*keep, *into])

    return documents.mapInArrow(run, schema)
