"""The queries over the standard tables that show each operator, and the SQL they must equal."""

from __future__ import annotations

import json
import lzma
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .functions import binary, checksum, codec
from .operators import ordered as op
from .plans.seq import Seq, pipe, track
from .session import drop_path, shared_dir
from .sources import memory, zip_format, zip_read, zip_source, zip_write
from .streaming.channel import Channel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> Seq:
    return memory.from_table(_t(spark, sf_dir, "events"), ["ts", "event_id"], ["user_id"])


def _as_frame(*stages) -> Callable[[Seq], DataFrame]:
    """A lazy sink: the composed plan."""
    return lambda s: reduce(lambda x, f: f(x), stages, s).df


@query("SELECT CAST(i - 1 AS BIGINT) AS ord, CAST(10 * i AS BIGINT) AS item FROM range(1, 6) t(i)")
def src_of_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.of(spark, 10, 20, 30, 40, 50).df


@query("SELECT CAST(1 AS BIGINT) AS ord, CAST(1 AS BIGINT) AS item WHERE false")
def src_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.empty(spark).df


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 2 AS doubled, l_returnflag FROM lineitem WHERE l_quantity > 25""")
def pipe_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = memory.from_table(_t(spark, sf_dir, "lineitem"), _LINE)
    return pipe(
        s,
        lambda q: q.map(lambda df: df.where("l_quantity > 25")),
        lambda q: q.df.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") * 2).alias("doubled"), "l_returnflag"),
    )


@query("""SELECT source, doc_id, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_so_far FROM documents""")
def tap_running_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = memory.from_table(_t(spark, sf_dir, "documents"), ["doc_id"], ["source"])
    return op.running_sum("bytes_so_far", F.octet_length("text").cast("bigint"))(s.map(lambda df: df.select("source", "doc_id", "text"))).df.select("source", "doc_id", "bytes_so_far")


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents")
def tap_observe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Observation()
    s = memory.from_table(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    op.tap(seen, None, F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).alias("n_bytes"))(s).df.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(seen.get["n_rows"]).cast("bigint").alias("n_rows"), F.lit(seen.get["n_bytes"]).cast("bigint").alias("n_bytes"))


@query("""SELECT user_id, CAST((rn - 1) // 4 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS batch_size, CAST(min(event_id) AS BIGINT) AS low, CAST(sum(event_id) AS BIGINT) AS total,
 string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2""")
def batch_count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.batch(4, ["event_id"])(_events(spark, sf_dir)).df
    ids = F.transform("items", lambda x: x["event_id"])
    return df.select("user_id", "batch_id", "batch_size", F.array_min(ids).alias("low"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_join(ids, ",").alias("ids"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, CAST(0 AS BIGINT) AS b, CAST(1 AS BIGINT) AS n, ms AS t0 FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN f.n >= 4 OR e.ms >= f.t0 + 600000 THEN f.b + 1 ELSE f.b END, CASE WHEN f.n >= 4 OR e.ms >= f.t0 + 600000 THEN 1 ELSE f.n + 1 END,
 CASE WHEN f.n >= 4 OR e.ms >= f.t0 + 600000 THEN e.ms ELSE f.t0 END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, b AS batch_id, CAST(count(*) AS BIGINT) AS batch_size, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM f GROUP BY 1, 2""")
def batch_count_time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.batch_timed(4, 600_000, "ts", ["event_id"])(_events(spark, sf_dir)).df
    return df.select("user_id", "batch_id", "batch_size", F.array_join(F.transform("items", lambda x: x["event_id"]), ",").alias("ids"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT k, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS rn
 FROM (SELECT CASE WHEN user_id % 5 > 0 THEN user_id + 9007199254740992 END AS k, event_id, ts FROM events)),
f AS (SELECT k, event_id, rn, CAST(0 AS BIGINT) AS b, CAST(1 AS BIGINT) AS n, ms AS t0 FROM e WHERE rn = 1
 UNION ALL SELECT e.k, e.event_id, e.rn, CASE WHEN f.n >= 4 OR e.ms >= f.t0 + 600000 THEN f.b + 1 ELSE f.b END, CASE WHEN f.n >= 4 OR e.ms >= f.t0 + 600000 THEN 1 ELSE f.n + 1 END,
 CASE WHEN f.n >= 4 OR e.ms >= f.t0 + 600000 THEN e.ms ELSE f.t0 END FROM f JOIN e ON e.k IS NOT DISTINCT FROM f.k AND e.rn = f.rn + 1)
SELECT coalesce(CAST(k AS VARCHAR), 'none') AS k, b AS batch_id, CAST(count(*) AS BIGINT) AS batch_size, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM f GROUP BY 1, 2""")
def batch_count_time_wide_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys beyond 2^53, and null for every fifth user: all of those are one sequence."""
    e = _t(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 > 0, F.col("user_id") + (1 << 53)).alias("k"), "event_id", "ts")
    df = op.batch_timed(4, 600_000, "ts", ["event_id"])(memory.from_table(e, ["ts", "event_id"], ["k"])).df
    return df.select(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("k"), "batch_id", "batch_size", F.array_join(F.transform("items", lambda x: x["event_id"]), ",").alias("ids"))


def _parties(spark: SparkSession, sf_dir: str) -> list[Seq]:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return [memory.from_table(c, ["id"]), memory.from_table(s, ["id"])]


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def merge_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge(*_parties(spark, sf_dir)).df


@query("""SELECT src_ord, id, name, CAST(row_number() OVER (ORDER BY src_ord, id) - 1 AS BIGINT) AS place
FROM (SELECT 0 AS src_ord, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)""")
def concat_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = op.concat(*_parties(spark, sf_dir))
    keyed = Seq(s.df.withColumn("one", F.lit(1).cast("bigint")).withColumn("spot", F.col("src_ord") * F.lit(1 << 40) + F.col("id")), ("spot",))
    return op.running_sum("place", F.col("one"))(keyed).df.select("src_ord", "id", "name", (F.col("place") - 1).alias("place"))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS inner_ord, ws[i] AS word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)""")
def flatmap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = memory.from_table(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return op.flat_map(F.split("text", " "), "word")(s).df.select("doc_id", "inner_ord", "word")


_ORDERED = f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {', '.join(_LINE)}) AS BIGINT) AS place, l_partkey, CAST(l_quantity AS BIGINT) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(_ORDERED)
def flatmap_orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = memory.from_table(_t(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")), _LINE)
    s = op.flat_map_table(inner, ["o_orderkey"])(memory.from_table(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]))
    keyed = Seq(s.df, tuple(_LINE), ("o_orderkey",))
    return keyed.df.select("o_orderkey", F.row_number().over(keyed.window()).cast("bigint").alias("place"), "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"))


@query("SELECT o_orderkey, o_custkey, l_partkey, CAST(l_quantity AS BIGINT) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def flatmap_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = memory.from_table(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity")), ["l_partkey"])
    s = op.flat_map_table(inner, ["o_orderkey"], concurrency=4)(memory.from_table(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]))
    return s.df.select("o_orderkey", "o_custkey", "l_partkey", "quantity")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM events) WHERE f = 0""")
def abort_after_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.abortable(F.col("event_type") == "error")(_events(spark, sf_dir)).df.select("user_id", "event_id", "event_type")


def _hours(spark: SparkSession, sf_dir: str) -> Seq:
    e = _t(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return memory.from_table(e.select("hour", "ts", "event_id", "event_type"), ["ts", "event_id"])


@query("SELECT event_id, event_type FROM events")
def buffer_suspend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.buffer(3, "suspend", ["hour"])(_hours(spark, sf_dir)).df.select("event_id", "event_type")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 3")
def buffer_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.buffer(3, "drop", ["hour"])(_hours(spark, sf_dir)).df.select("event_id", "event_type")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def buffer_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.buffer(3, "slide", ["hour"])(_hours(spark, sf_dir)).df.select("event_id", "event_type")


@query("SELECT CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS hour_ms, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) > 14")
def buffer_overflow_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.overflows(_hours(spark, sf_dir), 14, ["hour"]).select(F.unix_millis(F.col("hour").cast("timestamp")).alias("hour_ms"), "n")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def collect_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(hex(encode(text)), '' ORDER BY turn) AS bytes_hex, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM conversations GROUP BY 1")
def collect_bytes_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").withColumn("chunk", F.encode("text", "UTF-8"))
    b = memory.joined("chunk", ["turn"])
    return c.groupBy("conv_id").agg(F.hex(b).alias("bytes_hex"), F.octet_length(b).cast("bigint").alias("n_bytes"))


_TABLE = "t AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(0, 256) r(i)))"
_CRC = "xor(list_reduce(list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295), 4294967295)"


@query(f"WITH {_TABLE} SELECT conv_id, turn, {_CRC} AS crc FROM (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations), t")
def crc32_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", checksum.crc(F.col("text").cast("binary")).alias("crc"))


_CHUNKED = f"WITH {_TABLE} SELECT conv_id, {_CRC} AS crc FROM (SELECT conv_id, string_agg(hex(encode(text)), '' ORDER BY turn) AS h FROM conversations GROUP BY 1), t"


@query(_CHUNKED)
def crc32_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").withColumn("chunk", F.encode("text", "UTF-8"))
    return c.groupBy("conv_id").agg(checksum.crc_of_chunks("chunk", ["turn"]).alias("crc"))


@query(_CHUNKED)
def crc32_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.crc32(F.encode("text", "UTF-8")).alias("c"), F.octet_length("text").cast("bigint").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "c", "n"))), lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n")))
    return c.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", checksum.fold_parts(F.col("parts")).alias("crc"))


@query(f"WITH {_TABLE} SELECT doc_id, {_CRC} AS crc FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents), t")
def crc32_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", checksum.crc(F.encode("text", "UTF-8")).alias("crc"))


@query("""SELECT event_id, CAST(((year(ts) - 1980) << 9) | (month(ts) << 5) | day(ts) AS BIGINT) AS dos_date, CAST((hour(ts) << 11) | (minute(ts) << 5) | (second(ts) // 2) AS BIGINT) AS dos_time FROM events""")
def dos_time_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", binary.dos_date(F.col("ts")).alias("dos_date"), binary.dos_time(F.col("ts")).alias("dos_time"))


@query("""SELECT event_id, CAST(epoch_ms(date_trunc('second', ts)) // 2000 * 2000 AS BIGINT) AS back_ms FROM events""")
def dos_time_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", binary.dos_date(F.col("ts")).alias("d"), binary.dos_time(F.col("ts")).alias("t"))
    return e.select("event_id", F.unix_millis(binary.dos_timestamp(F.col("d"), F.col("t")).cast("timestamp")).alias("back_ms"))


@query("""SELECT o_orderkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS le32, o_orderkey AS back FROM (SELECT o_orderkey, printf('%08X', o_orderkey) AS h FROM orders)""")
def le_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", binary.le(F.col("o_orderkey"), 4).alias("b"))
    return o.select("o_orderkey", F.hex("b").alias("le32"), binary.le_read(F.col("b"), 0, 4).alias("back"))


def _turns(spark: SparkSession, sf_dir: str, compression: str = "store") -> DataFrame:
    """Every conversation as an archive with an entry a turn."""
    c = _t(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("archive"), F.col("turn").alias("ord"), F.concat("role", F.lit("/"), F.lpad(F.col("turn").cast("string"), 5, "0"), F.lit(".txt")).alias("name"),
        F.encode("text", "UTF-8").alias("content"), F.lit(compression).alias("compression"), F.lit("2024-06-15 14:30:22").cast("timestamp_ntz").alias("last_modified"), F.lit("").alias("comment"),
    )


def _documents(spark: SparkSession, sf_dir: str, compression: str = "store") -> DataFrame:
    """Every document as an archive of one entry, so that no archive grows with the input."""
    d = _t(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("archive"), F.lit(0).cast("bigint").alias("ord"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"),
        F.encode("text", "UTF-8").alias("content"), F.lit(compression).alias("compression"), F.lit("2024-06-15 14:30:22").cast("timestamp_ntz").alias("last_modified"), F.lit("").alias("comment"),
    )


@query(f"""WITH {_TABLE}, d AS (SELECT source, doc_id, source || '/' || doc_id || '.txt' AS name, strlen(text) AS size, hex(encode(text)) AS h FROM documents)
SELECT source, doc_id, name, {_CRC} AS crc, size, CAST(coalesce(sum(30 + strlen(name) + size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_header_offset FROM d, t""")
def zip_manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    e = d.select(F.col("source").alias("archive"), F.col("doc_id").alias("ord"), name.alias("name"), F.encode(name, "UTF-8").alias("raw_name"), F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.octet_length("text").cast("bigint").alias("csize"))
    e = e.withColumn("usize", F.col("csize"))
    return zip_write.placed(e, spread=True).select(F.col("archive").alias("source"), F.col("ord").alias("doc_id"), "name", "crc", F.col("csize").alias("size"), "local_header_offset")


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n_entries, CAST(sum(46 + strlen(source || '/' || doc_id || '.txt')) AS BIGINT) AS cd_size, CAST(sum(30 + strlen(source || '/' || doc_id || '.txt') + strlen(text)) AS BIGINT) AS cd_offset FROM documents GROUP BY 1""")
def zip_eocd_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    e = d.select(
        F.col("source").alias("archive"), F.col("doc_id").alias("ord"), F.encode(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")), "UTF-8").alias("raw_name"), F.lit(b"").alias("raw_comment"), F.octet_length("text").cast("bigint").alias("csize")
    ).withColumn("usize", F.col("csize"))
    return zip_write.ends(zip_write.placed(e)).withColumnRenamed("archive", "source")


@query(f"""WITH {_TABLE}, c AS (SELECT conv_id, turn, role || '/' || lpad(CAST(turn AS VARCHAR), 5, '0') || '.txt' AS name, hex(encode(text)) AS h FROM conversations),
n AS (SELECT conv_id, turn, name, {_CRC} AS crc, CAST(length(h) / 2 AS BIGINT) AS size FROM c, t),
x AS (SELECT *, printf('%08X', crc) AS ch, printf('%08X', size) AS sh, printf('%04X', strlen(name)) AS nh FROM n)
SELECT conv_id, turn, '504B0304140000080000CB73CF58' || substr(ch, 7, 2) || substr(ch, 5, 2) || substr(ch, 3, 2) || substr(ch, 1, 2)
 || substr(sh, 7, 2) || substr(sh, 5, 2) || substr(sh, 3, 2) || substr(sh, 1, 2) || substr(sh, 7, 2) || substr(sh, 5, 2) || substr(sh, 3, 2) || substr(sh, 1, 2)
 || substr(nh, 3, 2) || substr(nh, 1, 2) || '0000' || hex(encode(name)) AS header FROM x""")
def zip_store_header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = zip_write.layout(_turns(spark, sf_dir))
    return laid.select(F.col("archive").cast("bigint").alias("conv_id"), F.col("ord").alias("turn"), zip_write.local_header_hex().alias("header"))


_ORIGINAL = "SELECT CAST(doc_id AS VARCHAR) AS archive, source || '/' || doc_id || '.txt' AS name, text, 'ok' AS status FROM documents"


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("archive", "name", F.decode("content", "UTF-8").alias("text"), "status")


@query(_ORIGINAL)
def zip_roundtrip_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(zip_read.entries(zip_write.archives(_documents(spark, sf_dir))))


@query(_ORIGINAL)
def zip_roundtrip_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(zip_read.entries(zip_write.archives(_documents(spark, sf_dir, "deflate"))))


_SHELVED = "SELECT CAST({id} // 64 AS VARCHAR) AS archive, CAST(row_number() OVER (PARTITION BY {id} // 64 ORDER BY {id}) - 1 AS INTEGER) AS ordinal, '{what}/' || {id} || '.txt' AS name, {text} AS text, 'ok' AS status FROM {table}"


def _shelves(spark: SparkSession, sf_dir: str, table: str, key: str, text: str, what: str) -> DataFrame:
    """The rows in archives of 64 ids each, compressed in turn by deflate and not at all, read back."""
    d = _t(spark, sf_dir, table)
    e = d.select(
        F.floor(F.col(key) / 64).cast("string").alias("archive"), F.col(key).alias("ord"), F.concat(F.lit(f"{what}/"), key, F.lit(".txt")).alias("name"), F.encode(text, "UTF-8").alias("content"),
        F.when(F.col(key) % 3 > 0, "deflate").otherwise("store").alias("compression"), F.lit("2024-06-15 14:30:22").cast("timestamp_ntz").alias("last_modified"), F.lit("").alias("comment"),
    )
    return zip_read.entries(zip_write.archives(e)).select("archive", "ordinal", "name", F.decode("content", "UTF-8").alias("text"), "status")


@query(_SHELVED.format(id="doc_id", what="doc", text="text", table="documents"))
def zip_roundtrip_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shelves(spark, sf_dir, "documents", "doc_id", "text", "doc")


@query(_SHELVED.format(id="page_id", what="page", text="html", table="pages"))
def zip_roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shelves(spark, sf_dir, "pages", "page_id", "html", "page")


@query("SELECT CAST(doc_id AS VARCHAR) AS archive, source || '/' || doc_id || '.txt' AS name, CASE WHEN doc_id % 3 = 0 THEN 93 ELSE 8 END AS compression_method, text FROM documents WHERE doc_id % 5 > 0")
def zip_own_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third archive in a compression of the caller's own; entries whose signal fired are left out."""
    codec.register("lzma", 93, lzma.compress, lzma.decompress)
    e = _documents(spark, sf_dir, "deflate").withColumn("compression", F.when(F.col("archive").cast("bigint") % 3 == 0, "lzma").otherwise("deflate"))
    z = zip_write.archives(e.withColumn("aborted", F.col("archive").cast("bigint") % 5 == 0))
    return zip_read.entries(z).select("archive", "name", "compression_method", F.decode("content", "UTF-8").alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS archive, CAST(turn AS INTEGER) AS ordinal, role || '/' || lpad(CAST(turn AS VARCHAR), 5, '0') || '.txt' AS name, text FROM conversations")
def zip_forward_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_read.scan(zip_write.archives(_turns(spark, sf_dir, "deflate"))).select("archive", "ordinal", "name", F.decode("content", "UTF-8").alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS archive, role || '/' || lpad(CAST(turn AS VARCHAR), 5, '0') || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS uncompressed_size FROM conversations")
def zip_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_read.directory(zip_write.archives(_turns(spark, sf_dir))).select("archive", "name", "uncompressed_size")


@query("SELECT CAST(conv_id AS VARCHAR) AS archive, text FROM conversations WHERE role = 'user' AND turn = 2")
def zip_lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_read.lookup(zip_read.entries(zip_write.archives(_turns(spark, sf_dir))), "user/00002.txt").select("archive", F.decode("content", "UTF-8").alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS archive, role AS name, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2")
def zip_duplicate_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _turns(spark, sf_dir).withColumn("name", F.split("name", "/")[0])
    return zip_read.last_of_name(zip_read.entries(zip_write.archives(e))).select("archive", "name", F.decode("content", "UTF-8").alias("text"))


@query("SELECT CAST(doc_id AS VARCHAR) AS archive, CASE WHEN doc_id % 7 = 0 AND strlen(text) > 0 THEN 'crc_mismatch' ELSE 'ok' END AS status FROM documents")
def zip_corruption_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh archive gets its first data byte changed."""
    z = zip_write.archives(_documents(spark, sf_dir))
    at = 31 + binary.le_read(F.col("content"), 26, 2)
    h = F.hex("content")
    byte = F.conv(F.substring(h, 2 * at - 1, F.lit(2)), 16, 10).cast("bigint").bitwiseXOR(F.lit(255))
    flipped = F.unhex(F.concat(F.substring(h, F.lit(1), 2 * at - 2), F.lpad(F.hex(byte), 2, "0"), F.substring(h, 2 * at + 1, F.length(h))))
    bad = (F.col("archive").cast("bigint") % 7 == 0) & (binary.le_read(F.col("content"), 22, 4) > 0)
    return zip_read.entries(z.withColumn("content", F.when(bad, flipped).otherwise(F.col("content"))), permissive=True).select("archive", "status")


@query("SELECT CAST(0 AS BIGINT) AS differences, CAST(count(*) AS BIGINT) AS n FROM conversations")
def zip_forward_vs_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zip_write.archives(_turns(spark, sf_dir, "deflate"))
    a = zip_read.scan(z).select("archive", "ordinal", F.col("name").alias("n1"), F.crc32("content").alias("c1"))
    b = zip_read.entries(z).select("archive", "ordinal", F.col("name").alias("n2"), F.crc32("content").alias("c2"))
    j = a.join(b, ["archive", "ordinal"], "full_outer")
    same = F.coalesce((F.col("n1") == F.col("n2")) & (F.col("c1") == F.col("c2")), F.lit(False))
    return j.agg(F.count(F.when(~same, 1)).alias("differences"), F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_batch_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, gathered by micro-batch, against the batch result."""
    src = spark.readStream.schema(_t(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"sbe_{uuid.uuid4().hex}"
    agg = src.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
    state = f"{shared_dir(spark)}/{name}"
    agg.writeStream.format("memory").queryName(name).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    drop_path(spark, state)
    return spark.table(name)


@query(f"""WITH {_TABLE}, d AS (SELECT doc_id, strlen(text) AS size, hex(encode(text)) AS h FROM documents), n AS (SELECT doc_id, printf('%08X', {_CRC}) AS c, printf('%08X', size) AS s FROM d, t)
SELECT doc_id, '504B0708' || substr(c, 7, 2) || substr(c, 5, 2) || substr(c, 3, 2) || substr(c, 1, 2) || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2)
 || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2) AS descriptor FROM n""")
def zip_data_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = zip_write.layout(_documents(spark, sf_dir), descriptors=True)
    return laid.select(F.col("archive").cast("bigint").alias("doc_id"), zip_write.descriptor_hex().alias("descriptor"))


@query("SELECT CAST(conv_id AS VARCHAR) AS archive, CAST(turn AS INTEGER) AS ordinal, role || '/' || lpad(CAST(turn AS VARCHAR), 5, '0') || '.txt' AS name, text, text AS again FROM conversations")
def zip_scan_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives as a writer without seeks leaves them, read from the front and by the directory."""
    z = zip_write.archives(_turns(spark, sf_dir, "deflate"), descriptors=True)
    a = zip_read.scan(z).select("archive", "ordinal", "name", F.decode("content", "UTF-8").alias("text"))
    return a.join(zip_read.entries(z).select("archive", "ordinal", F.decode("content", "UTF-8").alias("again")), ["archive", "ordinal"])


@query("""SELECT o_orderkey, o_orderkey * 4294967296 AS usize, o_orderkey * 3 AS csize, o_orderkey * 1099511627 AS local_header_offset, 65535 + o_orderkey % 9 AS n_entries,
 o_orderkey * 46 AS cd_size, o_orderkey * 65536 AS cd_offset FROM orders""")
def zip64_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory and end records whose numbers need 64 bits, up to what a bigint holds, written by columns and parsed back."""
    k, when = F.col("o_orderkey").cast("bigint"), F.lit("2024-06-15 14:30:22").cast("timestamp_ntz")
    e = _t(spark, sf_dir, "orders").select(
        k.alias("o_orderkey"), F.lit(b"n").alias("raw_name"), F.lit(b"").alias("raw_comment"), F.lit(0).alias("method"), F.lit(1).cast("bigint").alias("crc32"),
        (k * (1 << 32)).alias("usize"), (k * 3).alias("csize"), (k * 1099511627).alias("local_header_offset"), when.alias("last_modified"),
    )
    end = zip_write.end_hex(65535 + F.col("o_orderkey") % 9, F.col("o_orderkey") * 46, F.col("o_orderkey") * 65536)
    made = e.select("o_orderkey", F.unhex(zip_write.central_hex()).alias("central"), F.unhex(end).alias("end"))
    return made.mapInPandas(_parsed_records, "o_orderkey long, usize long, csize long, local_header_offset long, n_entries long, cd_size long, cd_offset long")


def _parsed_records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for k, central, end in zip(f["o_orderkey"], f["central"], f["end"]):
            e, base = zip_format.parse_directory(bytes(central), 1, zip_format.BIGINT)[0], int(k) * 46 + int(k) * 65536  # the end record's place in its archive
            n, size, at = zip_format.directory_span(base + len(end), lambda at, n, end=bytes(end), base=base: end[max(0, at - base) : max(0, at + n - base)].rjust(n, b"\0"), zip_format.BIGINT)
            out.append((k, e.uncompressed_size, e.compressed_size, e.offset, n, size, at))
        yield pd.DataFrame(out, columns=["o_orderkey", "usize", "csize", "local_header_offset", "n_entries", "cd_size", "cd_offset"])


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the shared folder."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


@query("SELECT role || '/' || conv_id || '-' || turn AS name, text, text AS again FROM conversations")
def zip_files_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written by the data source to the shared folder, read by it with seeks, and read as files."""
    zip_source.register(spark)
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    e = _turns(spark, sf_dir).withColumn("name", F.concat_ws("/", F.split("name", "/")[0], F.concat("archive", F.lit("-"), F.col("ord").cast("string"))))
    e.repartition(4, "archive").sortWithinPartitions("archive", "ord").write.format("strandzip").mode("append").save(path)
    a = spark.read.format("strandzip").option("path", f"{path}/*.zip").option("entries_per_partition", 2000).load()
    b = zip_read.entries(zip_read.from_files(spark, f"{path}/*.zip"))
    got = a.select("name", F.decode("content", "UTF-8").alias("text")).join(b.select("name", F.decode("content", "UTF-8").alias("again")), "name")
    rows = _kept(spark, got)
    drop_path(spark, path)
    return rows


@query("SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS name FROM nation WHERE n_nationkey < 10")
def stream_out_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pulled one by one in order, by a consumer that stops after ten."""
    s = memory.from_table(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("name")), ["ord"])
    rows = [tuple(r) for _, r in zip(range(10), memory.to_stream()(s))]
    return spark.createDataFrame(rows, "ord bigint, name string")


class _Lines:
    """A writer of JSON lines that appear under their name when it closes."""

    def __init__(self, folder: str, part: int):
        self.path, self.lines = f"{folder}/part-{part:05d}.json", []

    def write(self, row: Row) -> None:
        self.lines.append(json.dumps(row.asDict()))

    def close(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(f"{self.path}.tmp", "w") as f:
            f.write("\n".join(self.lines))
        os.replace(f"{self.path}.tmp", self.path)

    def abort(self) -> None:
        self.lines = []


@query("SELECT CAST(c_custkey AS BIGINT) AS ord, c_name AS name FROM customer")
def write_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition writes a file in the shared folder, which must be mounted; read back."""
    path = f"{shared_dir(spark).removeprefix('file:')}/written-{uuid.uuid4().hex}"
    s = memory.from_table(_t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("ord"), F.col("c_name").alias("name")), ["ord"])
    pipe(s, memory.write_to(lambda part: _Lines(path, part)))
    rows = _kept(spark, spark.read.schema("ord bigint, name string").json(f"{path}/*.json"))
    drop_path(spark, path)
    return rows


@query("SELECT CAST(r_regionkey AS BIGINT) AS ord, r_name AS item, CAST(1 AS BIGINT) AS seen FROM region")
def channel_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer that waits for its consumer after every write, in a mounted folder."""
    names = [r["r_name"] for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    path = f"{shared_dir(spark).removeprefix('file:')}/channel-{uuid.uuid4().hex}"
    c, seen = Channel(spark, f"{path}/in", "item string", in_flight=1), []

    def produce() -> None:
        for name in names:
            c.write([{"item": name}], timeout=120)
        c.close()

    t = threading.Thread(target=produce, daemon=True)
    t.start()
    c.consume(lambda df, i: seen.extend((r["ord"], r["item"], 1) for r in df.collect()), f"{path}/state")
    t.join()
    drop_path(spark, path)
    return spark.createDataFrame(seen, "ord bigint, item string, seen bigint")


@query("SELECT * FROM (VALUES (0::BIGINT, 'sink'), (1::BIGINT, 'query stopped'), (2::BIGINT, 'near'), (3::BIGINT, 'far'), (4::BIGINT, 'raised: the sink')) t(ord, step)")
def pipe_teardown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that fails: its streaming query stops, finalizers run from the nearest to the farthest, and its error is the one raised."""
    log: list[str] = []

    class Query:
        def stop(self) -> None:
            log.append("query stopped")

    def sink(s: Seq) -> None:
        track(Query())
        log.append("sink")
        raise RuntimeError("the sink")

    try:
        pipe(memory.of(spark, 1), op.finalize(lambda: log.append("far")), op.finalize(lambda: log.append("near")), sink)
    except RuntimeError as e:
        log.append(f"raised: {e}")
    return spark.createDataFrame(list(enumerate(log)), "ord bigint, step string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Where the flagship finds its tables unless STRANDKIT_SF_DIR names another folder: the driver's smallest.
SMALLEST = "/root/testdata/sf0.001"


def flagship(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return zip_manifest_documents(spark, sf_dir or os.environ.get("STRANDKIT_SF_DIR", SMALLEST))
