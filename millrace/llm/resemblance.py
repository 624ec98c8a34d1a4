"""SimHash near-duplicates verified by the resemblance of word shingles, for stages of a pipeline.

Two texts are linked when the Jaccard similarity of their sets of SHINGLE-word shingles is at least
MIN_SIMILARITY. Candidates are what `simhash.links` finds by Golay keys among the fingerprints of the sets; every link is then
verified on the whole sets. Texts at similarity 0.8 differ in ten bits of 64 on average, beyond the four that
Golay keys reach, so sets that share one of BANDS keys, each made of ROWS minimum hashes, are candidates too
(a pair at similarity s shares one with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9998 at 0.8). Sets, not
documents, are keyed: texts with equal sets are joined first.

In a bucket of up to SMALL_BUCKET sets each pair is a candidate. A larger bucket is sent with its shingles
to one task, which compares them and lets out a spanning forest of the links only, never the pairs.
Components come from `simhash.components`.

Nulls and odd input: words are those of `simhash.fingerprint`; a null or empty text has the empty set, which
equals any other. A text of fewer words than a shingle is one shingle; long texts are read whole. Rows are
told by key and text, so null and repeated keys do no harm; a null key names a component only if all of its
keys are null. Ties do not arise. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, pieces
from millrace.llm.simhash import SEED, components, identified, links as golay_links, majority, named

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SMALL_BUCKET = 32
#: Up to so many sets (counted) with candidates are looked up in a broadcast, more by a shuffle of the documents.
BROADCAST_SETS = 1_000_000
_mix = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = (b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1)))
    return np.unique(np.fromiter((digest(r, SEED) for r in runs), dtype=np.uint64))


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def band_keys(found: np.ndarray, rows: int = ROWS) -> list[int]:
    """The keys of a set of shingles; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 2000):
        least = np.minimum(least, ((found[k : k + 2000, None] ^ _mix[0]) * _mix[1]).min(axis=0))
    raw = least.reshape(-1, rows)
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[b].tobytes(), b)).astype(np.int64)) for b in range(len(raw))]


def forest(ids: list[int], sets: list[np.ndarray], similarity: float = MIN_SIMILARITY) -> list[tuple[int, int]]:
    """Links that hold together what is linked among sets, one fewer than each group has members."""
    rest, out = np.arange(len(ids)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            sizes = np.array([len(sets[k]) for k in rest])
            every = np.concatenate([sets[k] for k in rest])
            at = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
            both = np.add.reduceat(sets[x][at] == every, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
            near = both >= similarity * (sizes + len(sets[x]) - both) - 1e-9
            out += [(ids[x], ids[k]) for k in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """The columns of one bucket after another; rows come sorted by the first column."""
    held: list[list] = [[] for _ in range(columns)]
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(columns)), strict=True):
            if held[0] and held[0][-1] != row[0]:
                yield held
                held = [[] for _ in range(columns)]
            for c, x in zip(held, row, strict=True):
                c.append(x)
    if held[0]:
        yield held


def links(documents: DataFrame, distinct: DataFrame, key: str, text: str, small: int = SMALL_BUCKET, similarity: float = MIN_SIMILARITY) -> DataFrame:
    """a, b: a spanning set of the links among the sets in distinct (sid, one, n, fp, bands)."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list = []
        b: list = []
        for bucket, ids, sizes in _by_bucket(batches, 3):
            if len(ids) > small:
                a += [(bucket[0])] * len(ids)
                b += [(i, True) for i in ids]
            elif len(ids) > 1:
                for i in range(len(ids)):
                    for j in range(i):
                        if min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]) - 1e-9:
                            a.append(min(ids[i], ids[j]))
                            b.append((max(ids[i], ids[j]), False))
            if len(a) > 10_000:
                yield rows(a, b)
                a, b = [], []
        yield rows(a, b)

    def rows(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([x for x, _ in b], pa.int64()), pa.array([y for _, y in b], pa.bool_())], ["a", "b", "large"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sets in _by_bucket(batches, 3):
            found = forest(ids, [np.array(s, dtype=np.int64).view(np.uint64) for s in sets], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    keyed = distinct.select(F.explode("bands").alias("bucket"), "sid", "n")
    found = durable(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(candidates, "a long, b long, large boolean").distinct())
    # sets of one fingerprint are candidates with the first of them, fingerprints that link by their first sets
    prints = durable(distinct.where("n > 0").groupBy("fp").agg(F.min("sid").alias("top"), F.count("*").alias("held")))
    equal = distinct.where("n > 0").join(prints.where("held > 1"), "fp").where("sid <> top").select(F.col("top").alias("a"), F.col("sid").alias("b"))
    left, right = prints.select(F.col("fp").alias("a"), F.col("top").alias("x")), prints.select(F.col("fp").alias("b"), F.col("top").alias("y"))
    close = golay_links(prints).join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(equal)
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = durable(found.where("not large").select("a", "b").unionAll(close).distinct())
    large = found.where("large").select(F.col("a").alias("bucket"), F.col("b").alias("sid"))
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionAll(large.select("sid")).distinct().join(distinct.select("sid", "one"), "sid"))
    few = needed.count() <= BROADCAST_SETS
    wanted = needed.select(F.col("sid").alias("_sid"), F.col("one.a").alias("a"), F.col("one.b").alias("b"))
    again = identified(documents, key, text).join(F.broadcast(wanted) if few else wanted, ["a", "b"]).select("_sid", text)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of repeated rows a task sends one
        for b in pieces(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sets = [shingles(t) if i not in seen else None for i, t in zip(ids, texts, strict=True)]
            same = [k for k, (i, s) in enumerate(zip(ids, sets, strict=True)) if s is not None and set_id(s) == i and i not in seen and not seen.add(i)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(same, pa.int64())), pa.array([sets[k].view(np.int64) for k in same], pa.list_(pa.int64()))], ["sid", "held"])

    sets = durable(again.mapInArrow(hashed, "sid long, held array<long>"))
    left, right = sets.select(F.col("sid").alias("a"), F.col("held").alias("x")), sets.select(F.col("sid").alias("b"), F.col("held").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")
    trees = large.join(sets, "sid").select("bucket", "sid", "held").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compared, "a long, b long")
    return near.unionAll(trees)


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL_BUCKET, similarity: float = MIN_SIMILARITY, rows: int = ROWS) -> DataFrame:
    """A row for each row of documents: a, b, key, sid, component_id and root, as in simhash.grouped. rows: minimum hashes a key, fewer for a lower similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            sets = [shingles(t) for t in x.column(3).to_pylist()]
            fps, bands = [majority(s) if len(s) else 0 for s in sets], [band_keys(s, rows) for s in sets]
            columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*x.columns[:3], *columns], ["a", "b", key, "sid", "n", "fp", "bands"])

    kind = dict(documents.dtypes)[key]
    prints = durable(identified(documents, key, text).mapInArrow(run, f"a long, b long, {key} {kind}, sid long, n int, fp long, bands array<long>"))
    distinct = durable(prints.groupBy("sid").agg(F.min(key).alias("first"), F.min(F.struct("a", "b")).alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    names = named(distinct, components(links(documents, distinct, key, text, small, similarity)), "sid")
    return prints.select("a", "b", key, "sid").join(names, "sid").select("a", "b", key, "sid", "component_id", "root")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL_BUCKET, similarity: float = MIN_SIMILARITY, rows: int = ROWS) -> DataFrame:
    """A row for each row of documents: key, component_id."""
    return grouped(documents, key, text, small, similarity, rows).select(key, "component_id")
