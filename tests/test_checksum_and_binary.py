import random
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandkit.functions import binary, checksum, codec

VECTORS = {
    b"123456789": 0xCBF43926, b"": 0, bytes(4): 0x2144DF1C, b"\xff" * 4: 0xFFFFFFFF, b"\x00": 0xD202EF8D, b"\xff": 0xFF000000,
    bytes(32): 0x190A55AD, b"\xff" * 32: 0xFF6CAB0B, bytes.fromhex("F20183"): 0x24AB9D77, bytes.fromhex("0FAA0055"): 0xB6C9B287,
    bytes.fromhex("00FF5511"): 0x32A06212, bytes.fromhex("332255AABBCCDDEEFF"): 0xB0AE863D, bytes.fromhex("926B55"): 0x9CDEA29B,
    b"The quick brown fox jumps over the lazy dog": 0x414FA339, bytes(range(32)): 0x91267E8A,
}


def test_vectors(spark):
    df = spark.createDataFrame([(bytearray(k),) for k in VECTORS], "b binary").select("b", checksum.crc(F.col("b")).alias("c"))
    assert {bytes(r["b"]): r["c"] for r in df.collect()} == VECTORS


def test_combine_at_every_cut(spark):
    whole = b"123456789"
    for i in range(len(whole) + 1):
        assert checksum.combine(zlib.crc32(whole[:i]), zlib.crc32(whole[i:]), len(whole) - i) == 0xCBF43926
    r = random.Random(1)
    rows = []
    for k in range(20):
        parts = [r.randbytes(r.choice([0, 1, 7, 300, 70_000])) for _ in range(4)]
        rows += [(k, i, bytearray(p)) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "k int, i int, b binary")
    folded = F.transform(F.array_sort(F.collect_list(F.struct("i", F.crc32("b").alias("c"), F.octet_length("b").cast("bigint").alias("n")))), lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n")))
    got = df.groupBy("k").agg(checksum.crc_of_chunks("b", ["i"]).alias("a"), folded.alias("p")).select("k", "a", checksum.fold_parts(F.col("p")).alias("c")).collect()
    for x in got:
        want = zlib.crc32(b"".join(bytes(b) for k, _, b in rows if k == x["k"]))
        assert x["a"] == x["c"] == want


def test_little_endian(spark):
    row = spark.range(1).select(F.hex(binary.le(0x01020304, 4)).alias("a"), F.hex(binary.le(1, 8)).alias("b"), binary.le_read(F.unhex(F.lit("FFFFFFFF")), 0, 4).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("04030201", "0100000000000000", 0xFFFFFFFF)
    with pytest.raises(Exception, match="2\\^53"):
        spark.range(1).select(binary.le_read(F.unhex(F.lit("00000000000020FF")), 0, 8)).collect()


def test_dos_times(spark):
    t = datetime(2024, 6, 15, 14, 30, 22)
    df = spark.createDataFrame([(t,), (datetime(1970, 3, 2, 1, 1, 1),)], "t timestamp_ntz")
    d, s = binary.dos_date(F.col("t")), binary.dos_time(F.col("t"))
    got = [r[0] for r in df.select(binary.dos_timestamp(d, s)).collect()]
    assert got == [t, datetime(1980, 3, 2, 1, 1, 0)]
    zero = spark.range(1).select(binary.dos_timestamp(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))).first()[0]
    assert zero == datetime(1979, 11, 30)


def test_deflate_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"ABCDEFGH" * 1000),), (bytearray(b""),), (None,)], "b binary").select("b", codec.deflate("b").alias("d"))
    rows = df.select("b", "d", codec.inflate("d").alias("i")).collect()
    assert [r["i"] for r in rows] == [r["b"] for r in rows] and len(rows[0]["d"]) < 100
