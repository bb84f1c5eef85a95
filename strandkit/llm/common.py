"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import drop_path, shared_dir

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, so a lost executor costs no recomputation and no result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, until: ExitStack) -> DataFrame:
    """Writes the frame as a compressed table in the shared checkpoint folder and reads it back: for large rows that are used twice. The
    table is removed when `until` closes, however it does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    until.callback(drop_path, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives free memory of this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For a function over batches: when it ends, its worker gives free memory back. Workers are used again and would else hold what
    their largest batch took, beside whatever runs next."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def held_out(doc_id: str, mod: int, remainder: int, equal: bool = True) -> Column:
    """Whether a row is outside the training rows; a null id is never learned from and counts as held out."""
    r = F.crc32(F.col(doc_id).cast("string")) % mod
    return F.coalesce((r == remainder) if equal else (r != remainder), F.lit(True))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame has not got (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__sk_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def lowest(rows: DataFrame, by: str, key: str, most: dict) -> list[Row]:
    """For each value of `by` that `most` names, its most[value] = (k, n) rows of lowest hash of `key`, where n is how many it has.

    A sample that does not depend on partitioning. Hashes are spread evenly, so a limit on them leaves about twice the rows wanted, and
    few rows meet anywhere; where it leaves too few, all rows of that value are sorted, each task handing on its first k.
    """
    h = F.xxhash64(key)
    limit = F.lit(None).cast("long")
    for value, (k, n) in most.items():
        share = (2 * k + 100) / max(1, n)
        limit = F.when(F.col(by) == value, F.lit(2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63)).otherwise(limit)
    got: dict = {value: [] for value in most}
    for r in rows.withColumn("__hash", h).where(F.col("__hash") <= limit).collect():
        got[r[by]].append(r)
    out = []
    for value, (k, n) in most.items():
        found = got[value]
        if len(found) < min(k, n):
            found = rows.withColumn("__hash", h).where(F.col(by) == value).orderBy("__hash", key).limit(k).collect()
        out += sorted(found, key=lambda r: (r["__hash"], r[key]))[:k]
    return out


def labelled_ids(labels: DataFrame, label: str, learn: Column, per_class: int | tuple[int, int]) -> list[Row]:
    """(doc_id, label): for each class the `per_class` ids (or as many as its element says) of lowest hash, a bounded sample that does not depend on partitioning.

    Rows with a null id or label do not count; where an id has several labels the largest holds.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(learn)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    zero, positive = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    n = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    return lowest(one, "label", "doc_id", {v: (k, n[v]) for v, k in ((0, zero), (1, positive)) if v in n})


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int | tuple[int, int]) -> list[tuple[str, int]]:
    """At most per_class (text, label) pairs of each class for training on the driver; the ids, at most as many, are broadcast."""
    chosen = [(r["doc_id"], r["label"]) for r in labelled_ids(labels, label, learn, per_class)]
    ids = docs.sparkSession.createDataFrame(chosen, StructType([StructField("doc_id", labels.schema["doc_id"].dataType), StructField("label", IntegerType())]))
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .collect()
    )
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected (a, b) edges, for every id of an edge.

    Alternates large-star and small-star steps until the edges are stars, which takes about the square of the logarithm of the nodes
    in rounds at most; each is a grouped minimum and a join, checkpointed, and nothing but counts come to the driver. Self-loops and
    nulls count for nothing. An empty input gives an empty result.
    """
    e = cut(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        # large star: every neighbour above a node goes to the node's smallest neighbour or itself
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and the node, go to its smallest one
        low = large.where(F.col("a") != F.col("b")).distinct()
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a")
        step = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(m.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        step = cut(step)
        # done when no node is both child and parent, and each child has one parent: the edges are stars
        n = step.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k")).first()
        inner = step.select(F.col("a").alias("b")).distinct().join(step.select("b").distinct(), "b").limit(1).count()
        e = step
        if n["n"] == n["k"] and inner == 0:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """Joins with `small`, broadcast only where its counted rows stay under `most`; beyond it, the shuffled join of the same rows."""
    small = cut(small)
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)
