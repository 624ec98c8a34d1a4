"""Operator 3, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed starts at every word of a test item and is the shortest run of at least MIN_SEED words whose
information under the corpus's word frequencies reaches SEED_BITS; so a seed is long where its words
are common and short where they are rare, and how often seeds meet by chance does not depend on how
often an item was copied. Seeds of the documents are joined to those of the items by a 64-bit hash of
their words. Documents that hold a seed are aligned with its item over the surrounding words (match +2,
other word -1, gap -1); an item leaks into a document when the best local alignment reaches MIN_SCORE of
the score of a perfect copy.

Documents are read three times: to count the words of the items, over all documents; to send the runs
that may be seeds, which a mask of the items' seeds picks (2**MASK_BITS slots at most; a fuller mask lets
more rows through to the join, never fewer); and, of those that hold a seed only, to align. Items are
nowhere held together: neither their number nor that of their words is bounded, and items of equal text
are joined and aligned once. What is broadcast is the mask, and seeds, hits and leaking rows up to
BROADCAST_ROWS of them, counted; beyond, they are joined by shuffles.

Nulls and odd input: null texts and items count as empty and never match; items whose whole text holds
less than SEED_BITS of information cannot be told from chance and are skipped. Long texts are read whole;
only the words around seeds are aligned. Repeated documents and items each give their own rows; rows are
told by key and text, so null and repeated keys do no harm. Of alignments of one score the first found
stands. Without documents or items nothing leaks. Extra columns are ignored by `leaks` and carried by
`drop_leaking`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, pieces, unused
from millrace.llm.simhash import identified, numbered

TOKEN = re.compile(r"\w+")
MIN_SEED = 3
#: A seed of more words than this is cut; what it then lacks in information the alignment makes good.
MAX_SEED = 62
SEED_BITS = 30.0
MIN_SCORE = 0.5
MASK_BITS = 22
BROADCAST_ROWS = 1_000_000
#: Characters whose words are hashed together.
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_word_table: list[np.ndarray] = []
_POSITIVE = np.int64((1 << 63) - 1)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def word_table() -> np.ndarray:
    """For every code point whether TOKEN takes it."""
    if not _word_table:
        _word_table.append(np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _word_table[0]


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and their parts, together of about SEGMENT characters; parts end between words."""
    numbers: list[int] = []
    parts: list[str] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = at + SEGMENT
            while end < len(t) and TOKEN.match(t, end):
                end += 1
            numbers.append(k)
            parts.append(t[at:end])
            size, at = size + min(end, len(t)) - at, end
            if size >= SEGMENT:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, never 0, and the number of its text."""
    found, of = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for numbers, parts in _segments(texts):
        parts = [p.lower() for p in parts]
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # a word begins and ends where what TOKEN takes does
        edges = np.diff(np.concatenate(([False], word_table()[codes], [False])).view(np.int8))
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=sums[1:])
        h = _mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(codes) + 1)[start] + (end - start).astype(np.uint64))
        found.append(np.maximum(h, np.uint64(1)))
        begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])[:-1]))
        of.append(np.array(numbers, dtype=np.int64)[np.searchsorted(begins, start, side="right") - 1])
    return np.concatenate(found), np.concatenate(of)


def hashes(text: str | None) -> np.ndarray:
    return word_hashes([text])[0]


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, a 0 after each text; where each text begins."""
    h, of = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts)) + 1
    out = np.zeros(int(n.sum()), dtype=np.uint64)
    out[np.arange(len(h)) + of] = h
    return out, np.cumsum(n) - n


_power_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power_tables.get(base)
    if have is None or len(have) < n:
        p = np.ones(max(n, 1 << 18), dtype=np.uint64)
        p[1:] = np.uint64(base)
        have = _power_tables[base] = np.multiply.accumulate(p)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of runs of words."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_BASE, len(words)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(words) + 1)

    def of(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The hash of the n words from each place."""
        return _mixed((self.sums[at + n] - self.sums[at]) * self.back[at] + np.asarray(n, dtype=np.uint64))


def slots(prefixes: np.ndarray, bits: int) -> np.ndarray:
    return (prefixes >> np.uint64(64 - bits)).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score over words, with the passage range it covers. Words are numbers; -1 equals nothing."""
    n = len(passage)
    at = np.arange(n + 1)
    score, start = np.zeros(n + 1, dtype=np.int64), at.copy()
    best, lo, hi = 0, 0, 0
    for w in item:
        step = np.where((passage == w) & (w >= 0), 2, -1)
        new, origin = np.zeros(n + 1, dtype=np.int64), at.copy()
        diagonal, up = score[:-1] + step, score[1:] - 1
        take = np.where(diagonal >= up, diagonal, up)
        origin[1:] = np.where(diagonal >= up, start[:-1], start[1:])
        new[1:] = np.maximum(take, 0)
        origin[1:] = np.where(take > 0, origin[1:], at[1:])
        # gaps along the passage: the running maximum of score + position
        lifted = new + at
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, at, 0))
        new, origin = peak - at, origin[source]
        score, start = np.maximum(new, 0), np.where(new > 0, origin, at)
        k = int(score.argmax())
        if score[k] > best:
            best, lo, hi = int(score[k]), int(start[k]), k
    return best, lo, hi


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def word_counts(documents: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each of words (a hash, column word) stands in the documents, and in row 0 how many words of any kind do."""
    slot = F.shiftrightunsigned("word", 64 - MASK_BITS).cast("int")
    wanted = np.zeros(1 << MASK_BITS, dtype=bool)
    wanted[words.select(slot.alias("s")).distinct().toArrow().column(0).to_numpy()] = True  # at most 2**MASK_BITS rows
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, total, parts, held = shared.value, 0, [], 0

        def counted() -> pa.RecordBatch:
            words, n = (np.concatenate(v) for v in zip(*parts, strict=True))
            words, at = np.unique(words, return_inverse=True)
            sums = np.bincount(at, weights=n, minlength=len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.append(words.view(np.int64), 0)), pa.array(np.append(sums, total))], ["word", "n"])

        for x in pieces(batches):
            h = word_hashes(x.column(0).to_pylist())[0]
            total += len(h)
            parts.append(np.unique(h[mask[slots(h, MASK_BITS)]], return_counts=True))
            held += len(parts[-1][0])
            if held > 4_000_000:
                yield counted()
                total, parts, held = 0, [], 0
        if parts:
            yield counted()

    counts = documents.select(F.col(text)).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return durable(counts)


def seeds(items: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """seed, prefix, n (words), item, at: the seeds of items (item, words)."""
    placed = items.select("item", F.posexplode("words").alias("at", "word"))
    counts = word_counts(documents, placed.select("word"), text)
    total = counts.where("word = 0").select(F.col("n").alias("total"))
    bits = F.log2(F.greatest("total", F.lit(1)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    # as many rows as an item has words
    weighed = placed.join(counts.where("word <> 0"), "word", "left").crossJoin(F.broadcast(total)).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.greatest(bits, F.lit(0.0)).alias("bits")))).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for item, held in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                words = np.array([r["word"] for r in held], dtype=np.int64).view(np.uint64)
                known = np.concatenate(([0.0], np.cumsum([r["bits"] for r in held])))
                m = len(words)
                if m < MIN_SEED:
                    continue
                start = np.arange(m - MIN_SEED + 1)
                n = np.maximum(np.searchsorted(known, known[:-1] + SEED_BITS - 1e-9)[: len(start)] - start, MIN_SEED)
                whole = start + n <= m
                start, n = start[whole], np.minimum(n[whole], MAX_SEED)
                runs = Runs(words)
                for column, v in zip(out, (runs.of(start, n).view(np.int64), runs.of(start, MIN_SEED).view(np.int64), n, np.full(len(start), item), start), strict=True):
                    column += v.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["seed", "prefix", "n", "item", "at"])

    return durable(weighed.mapInArrow(run, "seed long, prefix long, n long, item long, at long"))


def hits(rows: DataFrame, sown: DataFrame, text: str = "text") -> DataFrame:
    """a, b, item, starts: where in the rows (a, b and text) an item would begin, by the seeds that stand there."""
    bits = min(MASK_BITS, max(12, (8 * sown.count()).bit_length()))
    lengths = sown.groupBy(F.shiftrightunsigned("prefix", 64 - bits).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(n as int))")).alias("n")).toArrow()  # at most 2**bits rows
    mask = np.zeros(1 << bits, dtype=np.int64)
    mask[lengths.column("slot").to_numpy()] = lengths.column("n").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = shared.value
        used = [n for n in range(MIN_SEED, MAX_SEED + 1) if (sought >> n & 1).any()]
        for x in pieces(batches):
            words, begins = flat(x.column(2).to_pylist())
            if len(words) <= MIN_SEED:
                continue
            runs, ends = Runs(words), np.append(begins[1:], len(words)) - 1
            at = np.arange(len(words) - MIN_SEED)
            held = sought[slots(runs.of(at, MIN_SEED), bits)]
            at = at[held != 0]
            held, doc = held[held != 0], np.searchsorted(begins, at, side="right") - 1
            parts = []
            for n in used:
                some = np.flatnonzero((held >> n & 1 == 1) & (at + n <= ends[doc]))
                parts.append((doc[some], runs.of(at[some], n).view(np.int64), at[some] - begins[doc[some]]))
            if parts:
                doc, seed, place = (np.concatenate(v) for v in zip(*parts, strict=True))
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([x.column(0).take(of), x.column(1).take(of), pa.array(seed), pa.array(place)], ["a", "b", "seed", "place"])

    found = rows.select("a", "b", text).mapInArrow(run, "a long, b long, seed long, place long")
    met = found.join(_bounded(sown.select("seed", "item", "at")), "seed").select("a", "b", "item", (F.col("place") - F.col("at")).alias("start"))
    return durable(met.groupBy("a", "b", "item").agg(F.sort_array(F.collect_set("start")).alias("starts")))  # no more than the text's words


def aligned(rows: DataFrame, benchmark_items: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """a, b, item, score, first_word, end_word of every leak; rows: a, b and text."""
    with_words = found.join(_bounded(benchmark_items), "item")
    # what is gathered for a text: the items of which it holds a seed
    of_text = durable(with_words.groupBy("a", "b").agg(F.collect_list(F.struct("item", "words", "starts")).alias("asked")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for x in pieces(batches):
            out = []
            for a, b, t, asked in zip(*(x.column(c).to_pylist() for c in range(4)), strict=True):
                words = hashes(t).view(np.int64) & _POSITIVE
                for r in asked:
                    item, best = np.array(r["words"], dtype=np.int64) & _POSITIVE, (0, 0, 0)
                    m, reach = len(item), -1
                    for s in r["starts"]:
                        if s + 2 * m <= reach:
                            continue  # within what was aligned
                        lo, hi = max(0, s - m), min(len(words), s + 3 * m)
                        reach, passage = hi, words[lo:hi]
                        if (got := done.get(known := (r["item"], passage.tobytes()))) is None:
                            if len(done) > 5000:
                                done.clear()
                            got = done[known] = align(item, passage)
                        if got[0] > best[0]:
                            best = (got[0], got[1] + lo, got[2] + lo)
                    if best[0] >= MIN_SCORE * 2 * m:
                        out.append((a, b, r["item"], best[0] / (2 * m), best[1], best[2]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["a", "b", "item", "score", "first_word", "end_word"])

    texts = rows.join(_bounded(of_text), ["a", "b"]).select("a", "b", text, "asked")
    return texts.mapInArrow(run, "a long, b long, item long, score double, first_word long, end_word long")


def _item(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _leaks(documents: DataFrame, benchmark: DataFrame, key: str, text: str, item_text: str) -> DataFrame:
    """aligned() for the rows of documents; equal rows are aligned once or more."""
    spark = documents.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            held = [hashes(t).view(np.int64).tolist() for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(held, pa.list_(pa.int64()))], ["item", "words"])

    items = benchmark.select(_item(F.col(item_text)).alias("item"), F.col(item_text)).where(F.col(item_text).isNotNull()).dropDuplicates(["item"]).mapInArrow(words, "item long, words array<long>")
    items = durable(items)
    sown = seeds(items, documents, text)
    if sown.isEmpty():
        return spark.createDataFrame([], "a long, b long, item long, score double, first_word long, end_word long")
    rows = identified(documents, key, text)
    return durable(aligned(rows, items, hits(rows, sown, text), text))


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that leaks into it: keys, score (1: perfect copy), the document's words it covers."""
    found = _leaks(documents, benchmark, key, text, item_text).dropDuplicates(["a", "b", "item"])
    ids = benchmark.select(_item(F.col(item_text)).alias("item"), F.col(item_key).alias("_item_key"))
    leaking = identified(documents, key, text).select("a", "b", F.col(key).alias("_key")).join(_bounded(found), ["a", "b"])
    return leaking.join(_bounded(ids), "item").select(F.col("_key").alias(key), F.col("_item_key").alias(item_key), "score", "first_word", "end_word")


def drop_leaking(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """documents, with all their columns, without those into which an item leaks."""
    a, b = unused(documents, "_a"), unused(documents, "_b")
    gone = durable(_leaks(documents, benchmark, key, text, item_text).select(F.col("a").alias(a), F.col("b").alias(b)).distinct())
    return numbered(documents, key, text, a, b).join(_bounded(gone), [a, b], "left_anti").select(documents.columns)
