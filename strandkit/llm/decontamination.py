"""Benchmark decontamination by containment MinHash, with DataFrame functions only.

A document is far longer than a test item, so their Jaccard similarity is small whatever it holds; what counts is the share of the
item's shingles that the document contains. Items are partitioned by size; each keeps its sketch, the smallest of its shingles'
hashes, as many as its size partition needs for one of them to lie in any document that contains the threshold share. A document's
shingles are met with the sketches, which finds the candidates, and candidates are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

WORDS, THRESHOLD = 5, 80
#: Rows up to which a side is broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000
_TOKEN = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def shingles(text: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of words of each of the lengths."""

    def of(h: Column, k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + c) for c in range(k)]))
        return F.when(F.size(h) >= k, runs).otherwise(F.array().cast("array<bigint>"))

    # the array of one binds the words' hashes to a variable, so they are computed once
    bound = F.array(F.transform(words_of(text), lambda w: F.xxhash64(w)))
    return F.flatten(F.transform(bound, lambda h: F.concat(*[of(h, k) for k in lengths])))


def items_of(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """item_id, k, n, shingles: an item of fewer words is one shingle of all of them. Items without words and null ids are left out."""
    count = F.size(words_of(F.col("text")))
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text", F.least(count, F.lit(words)).alias("k")).where(F.col("k") > 0)
    per_k = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("text"), [k])) for k in range(1, words + 1)])
    # rows of one id are one item
    flat = rows.select("item_id", "k", F.explode(per_k).alias("shingle")).distinct()
    return flat.groupBy("item_id").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.array_sort(F.collect_set("shingle")).alias("shingles"))


def sketches(items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """item_id, shingle: the smallest hashes of each item. The partition holds sizes up to `top`; a document that lacks at most
    (100 - threshold) % of an item's shingles cannot lack all of that many and one more."""
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = F.least(F.floor(top * (100 - threshold) / 100) + 1, F.col("n"))
    return items.select("item_id", F.explode(F.slice("shingles", F.lit(1), k.cast("int"))).alias("shingle"))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every document that holds at least `threshold` % of an item's shingles.

    Rows of one id are taken together as one document or item, so repeated rows change nothing; rows with a null id are left out,
    null and empty texts hold nothing, and empty tables give an empty result. An item of fewer words than a shingle must occur whole.
    """
    items = cut(items_of(benchmark, words))
    lengths = [r["k"] for r in items.select("k").distinct().collect()] or [words]  # at most `words` values

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    full = items.select("item_id", F.explode("shingles").alias("shingle"))
    small = full.count() <= BROADCAST_ROWS
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sh = shingles(F.col("text"), lengths)
    candidates = cut(rows.select("doc_id", F.explode(sh).alias("shingle")).join(side(sketches(items, threshold)), "shingle").select("doc_id", "item_id").distinct())
    few = candidates.count() <= BROADCAST_ROWS  # and so are their documents
    ids = candidates.select("doc_id").distinct()
    again = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(sh)).alias("shingle"))
    met = again.join(side(full), "shingle").join(F.broadcast(candidates) if few else candidates, ["doc_id", "item_id"])
    shared = met.groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_shared"))
    sizes = items.select("item_id", F.col("n").alias("n_item"))
    return (
        shared.join(side(sizes), "item_id")
        .where(F.col("n_shared") * 100 >= F.col("n_item") * threshold)
        .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows whose document holds no item, with the columns they came with. Rows with a null id stay."""
    name = fresh(docs, "holds_item")
    bad = cut(contaminated(docs, benchmark, words, threshold).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, F.col("doc_id") == F.col(name), "left_anti")
