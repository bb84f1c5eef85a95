"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, in a fixed order of its documents, are packed into blocks of fixed length (a last, shorter block closes
a source). A source's target makes its number of slots, and these are drawn over the output shards, each slot alike: a source's counts
over the shards are one multinomial draw, of which its total is met exactly, and given a shard's size so are the shard's source counts.
The drawn counts number the slots: those of shard 0 come first, then those of shard 1, and so on. Slot i of a source takes block p(i):
full blocks in the order of a pseudorandom permutation of their indexes (a swap-or-not network keyed by source and epoch), the short
block last, then the next epoch with another permutation. Slots and blocks meet in a sort-merge join by source and block index; neither
side is ever broadcast, for both grow with the input.

A source's running word offsets come from two levels of sums, within buckets of documents and over the buckets, so a source that
holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_checked

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: What the sources share, as a multiple of all sizes, and what a target stays within, as a multiple of its source's size.
SHARE, CAP = 1.5, 2
#: Words a block; blocks an output shard on average; documents a bucket of the prefix sums; slots made at once.
BLOCK, SHARD_BLOCKS, BUCKET_DOCS, CHUNK = 128, 4096, 5_000, 1 << 12
ROUNDS, SEED = 16, 20_24


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the text that orders rows of one id. A null text has no words."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("order_hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, sid, source_size, n_docs, weight, target: one row a source, null last.

    The excess over `cap` times a size is shared again by weight until none is above. That ends with each target the lesser of its
    cap and one level times its weight; the level follows from the sources in order of cap over weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    ranked = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    found = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    return ranked.withColumn("target", F.least("cap", F.coalesce(found * F.col("weight"), F.col("cap")))).select(
        "source", "sid", "source_size", "n_docs", "weight", "target"
    )


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x, from 0 to n - 1, under a permutation keyed by `key`."""

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - acc, n)
        swap = F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(acc, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, step)


def _with_slots(plan: DataFrame, block: int) -> DataFrame:
    """sid, source_size, words (to take), full (blocks), blocks and n (slots) of every source with words."""
    size, words = F.col("source_size"), F.col("words")
    p = plan.where(size > 0).select("sid", "source_size", F.round("target").cast("long").alias("words"))
    p = p.withColumn("full", F.floor(size / block)).withColumn("blocks", F.ceil(size / block))
    return p.withColumn("n", F.floor(words / size) * F.col("blocks") + F.ceil(F.pmod(words, size) / block)).where(F.col("n") > 0)


def shard_counts(plan: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """sid, shard, n, first: how many slots of a source each output shard draws, and how many the shards before it drew.

    Every slot falls on one shard by a hash of its own and only counts leave a task, so the draw needs no state and reruns agree.
    """
    p = _with_slots(plan, block)
    total = p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(total / shard_blocks))
    # a few chunk rows become very many slots: a fixed number of partitions, as the rows' own size would have them all in one
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = p.select("sid", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("c")).repartition(parts, "sid", "c")
    each = chunks.select("sid", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("n"), (F.col("c") + 1) * CHUNK) - 1)).alias("i"))
    drawn = each.groupBy("sid", F.pmod(F.xxhash64(F.lit(SEED + 2), "sid", "i"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return drawn.withColumn("first", F.sum("n").over(before) - F.col("n"))


def slots(plan: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """sid, slot, shard, epoch, block, take: one row for each block that the mix takes, with the words it takes of its front."""
    size, words = F.col("source_size"), F.col("words")
    counts = cut(shard_counts(plan, block, shard_blocks))
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = join_checked(counts.withColumnRenamed("n", "drawn"), _with_slots(plan, block), ["sid"], most=200_000).repartition(parts, "sid", "shard")
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)))
    epoch, j = F.floor(F.col("slot") / F.col("blocks")), F.pmod("slot", "blocks")
    start = epoch * size + j * block
    return rows.select(
        "sid",
        "slot",
        "shard",
        epoch.alias("epoch"),
        F.when(j < F.col("full"), permuted(j, F.col("full"), F.col("sid"), epoch)).otherwise(j).alias("block"),
        F.least(F.lit(block), size - j * block, words - start).alias("take"),
    )


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with words, with their source's plan and `start`, the words of the source before theirs."""
    total = plan.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, math.ceil(total / BUCKET_DOCS)) * 4
    rows = sizes.where(F.col("size") > 0).withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    small = plan.withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    rows = join_checked(rows, small.select("k", "none", "sid", "source_size", "target"), ["k", "none"], most=200_000)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "order_hash"), F.lit(buckets)))
    w = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "order_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(w) - F.col("size"))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("sid", "bucket", (F.sum("n").over(over) - F.col("n")).alias("before"))
    return rows.join(sums, ["sid", "bucket"]).withColumn("start", F.col("run") + F.col("before")).drop("run", "before", "bucket", "k", "none")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each document gives to each block: words `low` up to `high` of the block, from word `at` of the document."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    b = F.col("block")
    return (
        rows.withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
        .withColumn("low", F.greatest(start, b * block) - b * block)
        .withColumn("high", F.least(end, (b + 1) * block) - b * block)
        .withColumn("at", b * block + F.col("low") - start)
    )


def mixed_pieces(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: shard, slot, sid, block, doc_id, word `at` of the document and `n` words from there, for every taken piece."""
    sizes = cut(sized(docs))
    plan = cut(targets(sizes, **how))
    joined = pieces(placed(sizes, plan)).join(slots(plan).hint("merge"), ["sid", "block"])
    n = F.least("high", "take") - F.col("low")
    return joined.withColumn("n", n).where(F.col("n") > 0).select("shard", "slot", "sid", "block", "doc_id", "low", "at", "n")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """shard, slot, text: the packed blocks of every shard, words joined by one space. Ids must be unique and not null."""
    parts = mixed_pieces(docs, **how).join(docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")), "doc_id")
    words = F.array_join(F.slice("w", (F.col("at") + 1).cast("int"), F.col("n").cast("int")), " ")
    got = parts.groupBy("shard", "sid", "slot").agg(F.array_sort(F.collect_list(F.struct("low", words.alias("t")))).alias("p"))
    return got.select("shard", "sid", "slot", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard: for every row, how many of its words the mix takes, repeats counted, and the first
    output shard that gets any of them (null if none does).

    A null source is a source of its own, after all others. Rows without words, null texts among them, have size and taken 0.
    Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are ignored.
    """
    sizes = cut(sized(docs))
    plan = cut(targets(sizes))
    gives = pieces(placed(sizes, plan)).join(slots(plan).hint("merge"), ["sid", "block"], "left")
    # blocks that no slot takes have no `take`; least() would skip the null
    n = F.when(F.col("take").isNotNull(), F.greatest(F.least("high", "take") - F.col("low"), F.lit(0))).otherwise(0)
    taken = gives.groupBy("sid", "start").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(n).cast("long").alias("taken"),
        F.min(F.when(n > 0, F.col("shard"))).alias("shard"),
    )
    small = plan.withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).select("k", "none", "source_size", "target")
    empty = sizes.where(F.col("size") == 0).withColumn("k", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    empty = join_checked(empty, small, ["k", "none"], most=200_000).withColumn("taken", F.lit(0).cast("long")).withColumn("shard", F.lit(None).cast("long"))
    names = ["doc_id", "size", "source_size", "target", "taken", "shard"]
    return taken.select(*names).unionByName(empty.select(*names))
