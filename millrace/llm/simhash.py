"""Operator 5, SimHash near-duplicates with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments, each padded with zeros to the 23 bits of the perfect
Golay code. A segment is decoded together with its 23 neighbours at one bit: this gives one codeword
index if it lies within two bits of a codeword and six if it lies at three, and any two segments up to
two bits apart share an index (both keep that of the word between them). Two fingerprints four bits apart
or less are caught by one of two kinds of keys (pigeonhole):

* Some segment has no error. Of the other two one has at most two, so they share a key made of the whole
  segment and an index of another.
* Each segment has one or two errors, so two have one each. One half of each of those is without error,
  so they share a key made of these halves and an index of the third segment.

Keys hold 31 to 34 bits, so buckets of chance meetings stay small up to some 10**10 fingerprints.
Fingerprints, not documents, are keyed: copies are joined first, so what a bucket can hold much of is
near copies of one text. Buckets of up to SMALL_BUCKET fingerprints let out each of their links, larger
ones a spanning forest of the links only: a cluster of any size sends one row less than it has members.
Components come from randomised contraction of the forest, each round cut by a durable checkpoint.

Nulls and odd input: null and empty texts have no shingle and the fingerprint zero, which links like
any other. A text of fewer words than a shingle is one shingle; a long text is read whole. Repeated rows
give repeated results; `deduplicate` tells rows by key and text, so that rows of one key and different
texts are judged apart. A null key never becomes a component's name unless all of its keys are null. Ties
do not arise: the smallest key names a component, and of rows with that key `deduplicate` keeps the one
whose hash is least. Extra columns pass through `deduplicate` and are ignored elsewhere. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, durable, pieces, unused

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Widths of the segments and their places, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Buckets up to this size are compared by shifts of all buckets at once, larger ones one at a time.
SMALL_BUCKET = 32
#: Up to so many components of several nodes, counted, their names are broadcast.
BROADCAST_GROUPS = 1_000_000


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words on division by GENERATOR."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1 == 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _nearby() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors that lead to the codewords kept, and how many they are."""
    patterns = [0]
    for weight in (1, 2, 3):
        patterns += [sum(1 << b for b in bits) for bits in _choose(23, weight)]
    leader = np.zeros(2048, dtype=np.int64)
    leader[syndrome(np.array(patterns))] = patterns
    out, many = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    flips = np.array([0] + [1 << b for b in range(23)])
    for s in range(2048):
        moved = leader[s] ^ flips
        errors = np.unique(flips ^ leader[syndrome(moved)])
        many[s] = len(errors)
        out[s] = np.resize(errors, 6)
    return out, many


def _choose(n: int, k: int) -> Iterator[tuple[int, ...]]:
    if k == 0:
        yield ()
        return
    for first in range(n - k + 1):
        for rest in _choose(n - first - 1, k - 1):
            yield (first, *(first + 1 + r for r in rest))


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def segment_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near each segment, in six columns of which the first `many` differ."""
    if not _tables:
        _tables.append(_nearby())
    errors, many = _tables[0]
    s = syndrome(segment)
    return (segment[:, None] ^ errors[s]) >> 11, many[s]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fingerprints; a key holds its kind and what it is made of."""
    unsigned = fingerprints.view(np.uint64)
    whole = [((unsigned >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [segment_keys(w) for w in whole]
    halves = [(w & 0x7FF, w >> 11) for w in whole]
    # (what must be equal, the segment whose index is taken)
    exact = [(whole[c], k) for c in range(3) for k in range(3) if k != c]
    exact += [(halves[a][i] << 11 | halves[b][j], c) for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 2, 0)) for i in range(2) for j in range(2)]
    rows, found = [], []
    for kind, (held, c) in enumerate(exact):
        index, many = near[c]
        for i in range(index.shape[1]):
            at = np.flatnonzero(many > i)
            rows.append(at)
            found.append(kind << 36 | held[at] << 12 | index[at, i])
    return np.concatenate(rows), np.concatenate(found)


def majority(hashes: np.ndarray) -> int:
    """The signed number whose bits are set where they are in more than half of the 64-bit hashes."""
    n, set_bits = len(hashes), np.zeros(64, dtype=np.int64)
    for k in range(0, n, 100_000):
        some = hashes[k : k + 100_000].astype("<u8")
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def _hash_a(key: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(1), key, text, text.isNull())


def _hash_b(key: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(2), text, text.isNull(), key)


def numbered(documents: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """documents with the two hashes of identified() in columns a and b."""
    return documents.withColumns({a: _hash_a(F.col(key), F.col(text)), b: _hash_b(F.col(key), F.col(text))})


def identified(documents: DataFrame, key: str, text: str) -> DataFrame:
    """a, b (128 bits of hash of key and text, which tell rows apart whatever their keys), key and text."""
    bounded_batches(documents.sparkSession)
    k, t = F.col(key), F.col(text)
    return documents.select(_hash_a(k, t).alias("a"), _hash_b(k, t).alias("b"), k, t)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b (see identified), the key of each row and its fingerprint, column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array([fingerprint(t) for t in x.column(3).to_pylist()], pa.int64())], ["a", "b", key, "fp"])

    return identified(documents, key, text).mapInArrow(run, f"a long, b long, {key} {dict(documents.dtypes)[key]}, fp long")


def forest(fps: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that hold together what is linked among distinct fingerprints, one fewer than each group has members."""
    rest, out = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= most
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of one partition, whose rows come sorted by key. A bucket that goes on in the next batch waits for it."""

    def work(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        small = np.repeat(size <= SMALL_BUCKET, size)
        a, b = [], []
        ks, fs = k[small], f[small]
        for lag in range(1, SMALL_BUCKET):
            same = np.flatnonzero(ks[lag:] == ks[:-lag])
            if not len(same):
                break
            near = same[np.bitwise_count((fs[same + lag] ^ fs[same]).view(np.uint64)) <= MAX_BITS]
            a.append(fs[near])
            b.append(fs[near + lag])
        for at, n in zip(first[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
            pairs = np.array(forest(f[at : at + n]), dtype=np.int64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        x, y = (np.concatenate(v) if v else k[:0] for v in (a, b))
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of what is not done, joined once their last bucket ends
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (held and held[-1][0][-1] != k[0]):
            held.append((k[:cut], f[:cut]))
            yield from work(*(np.concatenate(v) for v in zip(*held, strict=True)))
            held = []
        held.append((k[cut:], f[cut:]))
    if held:
        yield from work(*(np.concatenate(v) for v in zip(*held, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """a, b: a spanning set of the links among the fingerprints in column fp, which are distinct."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                rows, found = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 80) -> DataFrame:
    """node, root for every node of the edges a, b; the root is the smallest node of the component.

    Each round contracts: a node hangs on that node among itself and its neighbours which a new hash puts
    first, edges move to what their nodes hang on, and edges within one node vanish. A constant share of
    the nodes goes each round whatever the graph's shape, so chains, too, take a logarithm of rounds.
    """
    edges = durable(edges.where("a <> b"))
    rounds = []
    while not edges.isEmpty():
        if len(rounds) == most_rounds:
            raise RuntimeError("components did not settle")
        first = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), c.alias("v"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hang = both.groupBy("u").agg(F.min(first(F.col("v"))).alias("n")).select("u", F.least(F.col("n"), first(F.col("u")))["v"].alias("p"))
        rounds.append(hang := durable(hang))
        left, right = hang.select(F.col("u").alias("a"), F.col("p").alias("pa")), hang.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        edges = durable(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for hang in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("p"), F.col("root").alias("r"))
        roots = durable(hang.join(later, "p", "left").select(F.col("u").alias("node"), F.coalesce("r", "p").alias("root")))
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.least("root", "least").alias("root"))


def named(distinct: DataFrame, tree: DataFrame, node: str) -> DataFrame:
    """node, component_id, root of every row of distinct (node, first: its smallest key); tree: node and root of those that are linked."""
    linked = durable(distinct.select(node, "first").join(tree.withColumnRenamed("node", node), node))
    smallest = durable(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    # a component may hold most of the nodes: while the components are few, no node is shuffled to its own
    few = smallest.count() <= BROADCAST_GROUPS
    names = linked.join(F.broadcast(smallest) if few else smallest, "root").select(node, "component_id", "root")
    alone = distinct.select(node, "first").join(linked.select(node), node, "left_anti").select(node, F.col("first").alias("component_id"), F.col(node).alias("root"))
    return names.unionAll(alone)


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of documents: a, b (see identified), key, fp, component_id (the smallest key of its component), root (what tells components apart)."""
    prints = durable(fingerprints(documents, key, text))
    distinct = durable(prints.groupBy("fp").agg(F.min(key).alias("first")))
    names = named(distinct, components(links(distinct)), "fp")
    return prints.join(names, "fp").select("a", "b", key, "fp", "component_id", "root")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of documents: key, fp, component_id."""
    return grouped(documents, key, text).select(key, "fp", "component_id")


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = grouped) -> DataFrame:
    """documents, with all their columns: of each component (by find) the one row whose key is smallest (null last), of its rows with that key the one whose hash is least."""
    found = durable(find(documents, key, text).select("a", "b", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "a", "b").alias("_at"), "root"))
    several = durable(found.groupBy("root").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("root", "_first"))
    few = several.count() <= BROADCAST_GROUPS
    goes = found.join(F.broadcast(several) if few else several, "root").where("_at <> _first").select("a", "b").distinct()
    again = durable(found.groupBy("a", "b").agg(F.count("*").alias("_n")).where("_n > 1").select("a", "b"))
    a, b = unused(documents, "_a"), unused(documents, "_b")
    goes, again = (x.select(F.col("a").alias(a), F.col("b").alias(b)) for x in (goes, again))
    kept = numbered(documents, key, text, a, b).join(goes, [a, b], "left_anti")
    if not again.isEmpty():
        # only equal rows meet each other
        once = kept.join(again, [a, b], "left_semi").dropDuplicates([a, b])
        kept = kept.join(again, [a, b], "left_anti").unionByName(once)
    return kept.select(documents.columns)
