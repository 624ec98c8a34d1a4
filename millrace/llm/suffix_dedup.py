"""Operator 4, removal of long repeated byte strings by column-wise multi-document construction.

The full construction (one symbol of every document a round) needs as many rounds as the longest
document has bytes. Here it runs over windows, which bounds the rounds without losing a repeat:

1. Every string of LENGTH bytes has a minimizer, the GRAM-byte substring whose hash is least (the
   leftmost of equals). It depends on the string's bytes alone, so equal strings have equal minimizers
   at equal places. Neighbouring strings with one minimizer form a run. Runs are counted by minimizer;
   a run whose minimizer stands once in the corpus holds no repeat and is left out.
2. Runs with equal content are joined by hash: all of their bytes repeat.
3. The contents that remain differ but share a minimizer. They are the documents of the construction:
   aligned at the minimizer, they get one symbol each a round, from the last column to the first. A
   round sorts the symbols stably by the order of the round before, which gives the column of the
   collection's (positional) Burrows-Wheeler transform, and updates the common prefixes of neighbours
   by range minima. Strings whose common prefix with a neighbour reaches LENGTH repeat. Columns and
   marks lie in sequential temporary files, read and written one column a round; what stays in memory
   is a few numbers for each string. Rounds never exceed 2 * LENGTH.

Counts are aggregated before they are shuffled and joins on hot minimizers are left to adaptive skew
splitting; only distinct contents reach the construction.

Matches never cross documents. Nulls and odd input: a null text counts as empty; texts shorter than
LENGTH have nothing to remove. Repeated rows repeat each other's bytes, so each of them is removed
whole. A row is told from others by 128 bits of hash over its key and text, so null and repeated keys
do no harm. Contents are joined by a 64-bit hash under an equal 64-bit minimizer hash. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, discard, durable, pieces, release, spill

LENGTH = 200
GRAM = 32
#: Strings that one construction takes, unless a single minimizer has more.
CHUNK = 30_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            p = np.ones(max(n, 1 << 16), dtype=np.uint64)
            p[1:] = np.uint64(base)
            _powers[base] = have = np.multiply.accumulate(p)
    return have[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every substring of `gram` bytes."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * _power(_INVERSE, n - gram + 1)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, v
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, first window, number of windows, place of the minimizer after the first window, minimizer hash, content hash."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    whole = b"".join(texts)
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    if len(whole) < length:
        return none
    h = gram_hashes(np.frombuffer(whole, dtype=np.uint8), gram)
    place = np.uint64(0xFFFFFFFF)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    low = sliding_min(low, length - gram + 1)
    at = (low & place).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + length <= ends[doc]
    opens = valid.copy()
    opens[1:] &= ~(valid[:-1] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
    first = np.flatnonzero(opens)
    if not len(first):
        return none
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | opens[1:]
    last = np.flatnonzero(closes)
    digest = xxhash.xxh3_64_intdigest
    content = np.array([digest(whole[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], dtype=np.uint64).view(np.int64)
    of = doc[first]
    return of, first - (ends - sizes)[of], last - first + 1, at[first] - first, h[at[first]].view(np.int64), content


class Columns:
    """Equal-width columns of bytes in a temporary file without a name, which goes with its handle."""

    def __init__(self, rows: int, width: int):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.data = np.memmap(self.file, dtype=np.uint8, mode="w+", shape=(rows, max(width, 1)))


def construct(contents: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH) -> Columns:
    """marks[w, s]: whether the string of `length` bytes from byte w of content s stands in another content of its group.

    left: the place of the minimizer in each content; group: ascending numbers from 0.
    """
    m = len(contents)
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    before, after = int(left.max()), int((sizes - left).max())
    columns, here = Columns(before + after, m), Columns(before + after, m)
    for k in range(0, m, 1024):
        block = np.zeros((min(1024, m - k), before + after), dtype=np.uint8)
        there = np.zeros_like(block)
        for i, c in enumerate(contents[k : k + 1024]):
            a = before - int(left[k + i])
            block[i, a : a + len(c)] = np.frombuffer(c, dtype=np.uint8)
            there[i, a : a + len(c)] = 1
        columns.data[:, k : k + 1024] = block.T
        here.data[:, k : k + 1024] = there.T
    marks = Columns(int((sizes - length).max()) + 1, m)
    order, lcp = np.arange(m), np.zeros(m, dtype=np.int32)
    wide = int(group[-1]) > 0xFFFF
    for col in range(before + after - 1, -1, -1):
        symbol, valid = columns.data[col], here.data[col].astype(bool)
        # insert: the stable sort by symbol within the groups; strings that have not begun go last
        s = np.where(valid, symbol.astype(np.uint16), np.uint16(256))[order]
        by = np.argsort(s, kind="stable")
        g = group[order[by]]
        by = by[np.argsort(g if wide else g.astype(np.uint16), kind="stable")]
        new = order[by]
        # common prefixes: one more than the least between the places that the neighbours had
        same = (group[new[1:]] == group[new[:-1]]) & (s[by[1:]] == s[by[:-1]]) & valid[new[1:]]
        least = np.zeros(m, dtype=np.int32)
        at = np.flatnonzero(same)
        if len(at):
            least[at + 1] = 1 + _range_min(lcp, by[at] + 1, by[at + 1])
        order, lcp = new, least
        if col <= before:
            long = lcp >= length
            long[:-1] |= long[1:].copy()
            found = order[long]
            w = col - (before - left[found])
            marks.data[w, found] = 1
    return marks


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of v[lo..hi], both included, for every pair."""
    n = hi - lo + 1
    out = np.empty(len(lo), dtype=v.dtype)
    level, width = v, 1
    while True:
        now = np.flatnonzero((n >= width) & (n < 2 * width))
        if len(now):
            out[now] = np.minimum(level[lo[now]], level[hi[now] - width + 1])
        if not (n >= 2 * width).any():
            return out
        level = np.minimum(level[:-width], level[width:])
        width *= 2


def _construct_all(length: int):
    """Over rows sorted by minimizer: a, b, start, left, need, content. Gives a, b, lo, hi of repeated bytes of the rows that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            _, group = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_inverse=True)
            marks = construct([r[6] for r in rows], np.array([r[4] for r in rows], dtype=np.int64), group, length).data
            a, b, lo, hi = [], [], [], []
            for i, (_, k1, k2, start, _, need, content) in enumerate(rows):
                if not need:
                    continue
                column = np.concatenate(([0], marks[: len(content) - length + 1, i], [0])).astype(np.int8)
                edge = np.diff(column)
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    a.append(k1), b.append(k2), lo.append(start + x), hi.append(start + y - 1 + length)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, lo, hi)], ["a", "b", "lo", "hi"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("mh", "a", "b", "start", "at", "need", "content")), strict=True)
            if len(held) > CHUNK:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                yield from work(held[:cut])
                held = held[cut:]
        yield from work(held)

    return run


def repeats(documents: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """a, b, lo, hi: byte ranges that repeat in the texts whose hash is a, b. `documents` has the columns a, b and text."""
    spark = documents.sparkSession
    bounded_batches(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            of, start, n, at, mh, ch = runs([t.encode("utf-8") if t else b"" for t in x.column(2).to_pylist()], length, gram)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([x.column(0).take(take), x.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(mh), pa.array(ch)], ["a", "b", "start", "n", "at", "mh", "ch"])

    all_runs, runs_path = spill(documents.select("a", "b", text).mapInArrow(find, "a long, b long, start int, n int, at int, mh long, ch long"), "runs")
    often = durable(all_runs.groupBy("mh").agg(F.count("*").alias("total")).where("total > 1").select("mh"))
    some, _ = spill(all_runs.join(often, "mh"), "repeated")
    discard(spark, runs_path)
    release(spark)
    # copies are counted, and one of them picked, in parts before the shuffle
    kinds = durable(some.groupBy("mh", "ch").agg(F.count("*").alias("copies"), F.min(F.struct("a", "b", "start", "n", "at")).alias("one")))
    mixed = durable(kinds.groupBy("mh").agg(F.count("*").alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")).where("kinds > 1 and single > 0").select("mh"))
    copied = some.join(durable(kinds.where("copies > 1").select("mh", "ch")), ["mh", "ch"]).select("a", "b", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("n") - 1 + length).cast("long").alias("hi"))
    # of each content of a mixed minimizer one run, with whether it needs an answer
    asked = kinds.join(mixed, "mh").select("mh", "one.*", (F.col("copies") == 1).alias("need"))
    asked = durable(asked.groupBy("a", "b").agg(F.collect_list(F.struct("mh", "start", "n", "at", "need")).alias("asked")))  # as many as a text has runs
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            rows = []
            for a, b, t, wanted in zip(*(x.column(c).to_pylist() for c in range(4)), strict=True):
                data = t.encode("utf-8")
                rows += [(r["mh"], a, b, r["start"], r["at"], r["need"], data[r["start"] : r["start"] + r["n"] - 1 + length]) for r in wanted]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("mh", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32()), ("at", pa.int32()), ("need", pa.bool_()), ("content", pa.binary())])
    texts = documents.select("a", "b", text).join(asked, ["a", "b"]).dropDuplicates(["a", "b"]).select("a", "b", text, "asked")
    contents = texts.mapInArrow(cut, "mh long, a long, b long, start int, at int, need boolean, content binary")
    partly = contents.repartition("mh").sortWithinPartitions("mh").mapInArrow(_construct_all(length), "a long, b long, lo long, hi long")
    return copied.unionAll(partly)


def remove(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each row of documents: key, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed), kept (the remaining bytes)."""
    given = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    given = given.withColumns({"a": F.xxhash64(F.lit(1), key, "_text"), "b": F.xxhash64(F.lit(2), "_text", key)})
    # a text's ranges lie within it: what is gathered for one row is bounded by the row
    found, _ = spill(repeats(given, "_text", length, gram).groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "ranges")
    release(documents.sparkSession)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            out = []
            for t, ranges in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                data, spans = t.encode("utf-8"), []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"lo": p, "hi": q} for p, q in spans], kept))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()))]
            yield pa.RecordBatch.from_arrays([x.column(0), *columns], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    both = given.join(found, ["a", "b"], "left").select(key, "_text", "found")
    return both.mapInArrow(run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, kept binary")
