"""Operator 8, mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources get the weights of WEIGHTS in turn and share all words by them, none beyond MAX_REPEATS times
its own size (the excess is shared again). A source's documents fall into blocks by a hash of key and
text: BLOCKS of them, or as many as keep a block of the whole table at BLOCK_ROWS rows. A
target is met by whole passes over the blocks and one more pass over as many permuted blocks as the
rest asks for, the last of them cut between documents; so a source's words miss its target by about
half a document. The blocks drawn are then dealt to SHARDS output shards: a binary tree splits the
counts of all sources at once, each split drawing without replacement how many blocks of each source go
left (a multivariate hypergeometric draw), so that shards are equal in size and their mixture varies as
a random deal's would while every source's count is exact. A shard takes its quota as a stretch of the
source's permuted draws, and its documents are ordered by hash.

All of it is SQL expressions, aggregations, windows and joins. Windows are over the blocks of a source
(MAX_REPEATS draws of each at most), over the sources, or over the documents of one block; a source that
holds most rows is spread over its blocks. The sources and their draws are dealt by one task: there may
be MAX_SOURCES of them, more are refused. `mixed` deals its rows to partitions of about PART_BYTES by
counted bytes, so partitions grow in number, not in size. All draws come from hashes, so reruns agree.

Nulls and odd input: a null text has size 0 and is drawn like another; a null source is a source of its
own, last in order; with no words at all every target is 0. Rows equal in key and text stand in one block
and are taken together, so they have one plan; the cut may then miss by half of all of them. A long text is
a document like another. Extra columns pass through `mixed` and are ignored by `plan`. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import durable, let, n_words_of

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCKS = 1024
BLOCK_ROWS = 1_000_000
MAX_SOURCES = 10_000
SHARDS = 32
PART_BYTES = 128 << 20
SEED = 8
#: Up to this many blocks of all sources, counted, their draws are broadcast; beyond, rows are shuffled to them.
BROADCAST_BLOCKS = 200_000
ON = ("_none", "_s")
#: What `mixed` adds, in place of columns so named.
ADDED = ("mix_shard", "mix_pass", "mix_order")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """sources (source, source_size, and more) with target. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    df = df.withColumns({"_cap": F.col("source_size") * float(most), "_all": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    # the sources that reach their cap are those with the least cap for their weight; the others share the rest at one rate
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_rate", (F.col("_all") - capped) / free)
    df = df.withColumn("_rate", F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_rate"), F.struct((F.col("_cap") / F.col("_w")).alias("o"), F.col("_rate").alias("r")))).over(Window.partitionBy())["r"])
    return df.withColumn("target", F.least("_cap", F.coalesce(F.col("_rate") * F.col("_w"), F.lit(0.0)))).drop("_w", "_cap", "_all", "_rate")


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def _left(counts: Column, node: Column, left_leaves: Column, leaves: Column) -> Column:
    """How many of each source's draws go left: draws without replacement, one after the other, within equal capacity."""

    def of_source(a: Column, n: Column, k: Column) -> Column:
        drawn = F.aggregate(
            F.sequence(F.lit(1).cast("long"), n),
            F.struct(a["room"].alias("room"), a["rest"].alias("rest"), F.lit(0).cast("long").alias("x")),
            lambda b, i: let(
                (_uniform(node, k, i) * b["rest"] < b["room"]).cast("long"),
                lambda go: F.struct((b["room"] - go).alias("room"), (b["rest"] - 1).alias("rest"), (b["x"] + go).alias("x")),
            ),
            lambda b: b["x"],
        )
        return F.when(n > 0, drawn).otherwise(F.lit(0).cast("long"))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return let(
        total,
        lambda t: F.aggregate(
            counts,
            F.struct(F.floor(t * left_leaves / leaves).cast("long").alias("room"), t.alias("rest"), F.array().cast("array<bigint>").alias("out")),
            lambda a, n: let(
                of_source(a, n, F.size(a["out"])),
                lambda x: F.struct((a["room"] - x).alias("room"), (a["rest"] - n).alias("rest"), F.concat(a["out"], F.array(x)).alias("out")),
            ),
            lambda a: a["out"],
        ),
    )


def quotas(drawn: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, shard, quota from drawn (source, n): every source's n dealt out, the shards' totals differing by about one a level."""
    # a row for each source: as many as there are sources
    rows = drawn.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("source"), F.col("n").cast("long").alias("n")))).alias("v"))
    nodes = rows.select(F.transform("v", lambda x: x["source"]).alias("sources"), F.transform("v", lambda x: x["n"]).alias("counts"), F.lit(0).alias("first"), F.lit(shards).alias("leaves"))
    width = shards
    while width > 1:
        half = F.ceil(F.col("leaves") / 2).cast("int")
        split = nodes.withColumns({"half": half, "left": F.when(F.col("leaves") > 1, _left(F.col("counts"), F.col("first") * 1000 + F.col("leaves"), half, F.col("leaves"))).otherwise(F.col("counts"))})
        both = F.array(
            F.struct(F.col("left").alias("counts"), F.col("first").alias("first"), F.col("half").alias("leaves")),
            F.struct(F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"), (F.col("first") + F.col("half")).alias("first"), (F.col("leaves") - F.col("half")).alias("leaves")),
        )
        nodes = durable(split.select("sources", F.explode(both).alias("c")).select("sources", "c.*").where("leaves > 0"))
        width = -(-width // 2)
    return nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("sources", "counts")).alias("z")).select("shard", F.col("z.sources").alias("source"), F.col("z.counts").alias("quota"))


def _located(df: DataFrame, blocks: int) -> DataFrame:
    """df (with rid, the hash of each row) with its source and block, and its order within the block."""
    h = F.xxhash64(F.lit(SEED), "rid")
    return df.withColumns({"block": F.pmod(h, F.lit(blocks)).cast("int"), "within": F.xxhash64(F.lit(SEED + 1), "rid"), "_none": F.col("source").isNull(), "_s": F.coalesce("source", F.lit(""))})


def blocks_for(rows: int) -> int:
    return max(BLOCKS, -(-rows // BLOCK_ROWS))


def _dealt(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For every block of every source its draws, what is cut of it, and the source's sizes. df: located rows with size."""
    # blocks are summed in parts before they are shuffled
    by_block = durable(df.groupBy("_none", "_s", "block").agg(F.sum("size").alias("block_size")))
    sources = by_block.groupBy("_none", "_s").agg(F.sum("block_size").alias("source_size")).withColumn("source", F.when(~F.col("_none"), F.col("_s")))
    sources = durable(sources)
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = targets(sources)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(F.lit(0)).cast("int")
    sources = durable(sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    on = list(ON)
    permuted = Window.partitionBy(*on).orderBy(F.xxhash64(F.lit(SEED + 2), "_none", "_s", "block"), "block")
    at = F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("block_size")
    state = by_block.join(sources.drop("source"), on).withColumn("before", at)
    state = state.withColumn("part", F.when(F.col("before") + F.col("block_size") <= F.col("rest"), F.lit("all")).when(F.col("before") < F.col("rest"), F.lit("some")).otherwise(F.lit("none")))
    state = durable(state.withColumn("need", F.col("rest") - F.col("before")))
    # one draw of a block for each pass, dealt in a permuted order
    last = F.when(F.col("part") != "none", F.array(F.col("passes"))).otherwise(F.array().cast("array<int>"))
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    draws = state.select(*on, "block", F.explode(F.concat(whole, last)).alias("pass"))
    deal = Window.partitionBy(*on).orderBy(F.xxhash64(F.lit(SEED + 3), "_none", "_s", "pass", "block"), "pass", "block")
    draws = durable(draws.withColumn("turn", F.row_number().over(deal)))
    counted = draws.groupBy(*on).agg(F.count("*").alias("n")).select(F.when(~F.col("_none"), F.col("_s")).alias("source"), "n")
    quota = quotas(counted, shards).withColumns({"_none": F.col("source").isNull(), "_s": F.coalesce("source", F.lit(""))}).drop("source")
    upto = F.sum("quota").over(Window.partitionBy(*on).orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = quota.withColumn("upto", upto).where("quota > 0").select(*on, "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("turn"))
    dealt = draws.join(turns.withColumn("turn", F.col("turn").cast("int")), [*on, "turn"]).groupBy(*on, "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    return durable(dealt.join(state.select(*on, "block", "part", "need", "passes", "source_size", "target"), [*on, "block"], "right"))


def _bounded(dealt: DataFrame) -> DataFrame:
    return F.broadcast(dealt) if dealt.count() <= BROADCAST_BLOCKS else dealt


def _cut(cut: DataFrame) -> DataFrame:
    """Rows of the blocks that are cut: a document goes if most of it lies before the cut. Equal rows are peers in the window's order and share its sum."""
    within = Window.partitionBy(*ON, "block").orderBy("within", "rid")
    cut = cut.withColumn("_in", F.sum("size").over(within) - F.col("size") / 2 <= F.col("need"))
    return cut.withColumn("draws", F.when(F.col("_in"), F.col("draws")).otherwise(F.filter("draws", lambda d: d["pass"] < F.col("passes")))).drop("_in")


def plan(sized: DataFrame, key: str = "doc_id", shards: int = SHARDS, blocks: int | None = None) -> DataFrame:
    """sized (key, source, size, rid) with source_size, target, and draws: array<struct<pass, shard>>, one entry for each time a document is taken."""
    df = _located(sized, blocks or blocks_for(sized.count()))
    out = df.join(_bounded(_dealt(df, shards)), [*ON, "block"])
    empty = F.array().cast("array<struct<pass:int,shard:int>>")
    both = out.where("part <> 'some'").unionByName(_cut(out.where("part = 'some'")))
    return both.select(key, "source", "size", "source_size", "target", F.coalesce("draws", empty).alias("draws"))


def _rid(key: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), key, text, text.isNull())


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, rid of every document, and bytes, about what it takes; computed once."""
    t = F.col(text)
    return durable(documents.select(F.col(key), F.col(source).cast("string").alias("source"), n_words_of(t).alias("size"), _rid(F.col(key), t).alias("rid"), (F.coalesce(F.octet_length(t), F.lit(0)) + 100).cast("long").alias("bytes")))


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, taken, and draws: the pass and shard (pass:shard, comma-joined) of each time it is taken."""
    found = plan(sized(documents, key, text, source), key)
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["shard"].cast("string"))), ",")
    return found.select(key, "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), draws.alias("draws"))


def mixed(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture: documents with all their columns, a row for each time one is taken, with mix_shard, mix_pass and mix_order, in shard order."""
    small = sized(documents, key, text, source)
    total = small.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    blocks = blocks_for(total["rows"])
    small = _located(small, blocks)
    dealt = _dealt(small)
    block = [*ON, "block"]
    # documents are read again for the one block of each source that is cut, so that no more than it is joined by row
    some = dealt.where("part = 'some'")
    cut = _cut(small.join(_bounded(some), block)).groupBy(*ON, F.col("rid").alias("_cut_rid")).agg(F.max("draws").alias("draws")).where(F.size("draws") > 0)
    cut = durable(cut.select(F.col("_none").alias("_cut_none"), F.col("_s").alias("_cut_s"), "_cut_rid", "draws"))
    rows = documents.select(F.struct(*[c for c in documents.columns if c not in ADDED]).alias("_row"), _rid(F.col(key), F.col(text)).alias("rid"), F.col(source).cast("string").alias("source"))
    rows = _located(rows, blocks)
    whole = rows.join(_bounded(dealt.where("part <> 'some'").select(*block, "draws")), block)
    parts = rows.join(_bounded(some.select(*block)), block, "left_semi")
    parts = parts.join(cut, (parts["_none"] == cut["_cut_none"]) & (parts["_s"] == cut["_cut_s"]) & (parts["rid"] == cut["_cut_rid"]))
    rows = whole.select("_row", "rid", "draws").unionAll(parts.select("_row", "rid", "draws")).select("_row", "rid", F.explode("draws").alias("_d"))
    rows = rows.select("_row.*", F.col("_d.shard").alias("mix_shard"), F.col("_d.pass").alias("mix_pass"), F.xxhash64(F.lit(SEED + 4), "_d.shard", "_d.pass", "rid").alias("mix_order"))
    # every shard is cut by order into as many parts as its bytes ask for; the words taken are as many as there are
    parts_of = max(1, -(-(total["bytes"] or 0) // (SHARDS * PART_BYTES)))
    part = F.floor((F.shiftrightunsigned("mix_order", 11) / F.lit(float(1 << 53))) * parts_of)
    return rows.repartitionById(SHARDS * parts_of, (F.col("mix_shard") * parts_of + part).cast("int")).sortWithinPartitions("mix_shard", "mix_order")
