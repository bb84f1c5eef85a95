import io
import os
import random
import struct
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandkit.errors import ArchiveAborted, BadEntry, CorruptArchive, typed_errors
from strandkit.functions import codec
from strandkit.plans import pipe
from strandkit.sources import memory, zip_read, zip_source, zip_write
from strandkit.sources import zip_format as z

INPUT = "archive string, ord bigint, name string, content binary, compression string, last_modified timestamp_ntz, comment string"
WHEN = datetime(2024, 6, 15, 14, 30, 22)


def entries(spark, rows):
    return spark.createDataFrame([("a", i, n, None if c is None else bytearray(c), how, WHEN, note) for i, (n, c, how, note) in enumerate(rows)], INPUT)


SOME = [("empty.txt", b"", "store", None), ("all.bin", bytes(range(256)), "deflate", None), ("ünï/日.txt", "é".encode(), None, "a note"), ("big", b"ABCDEFGH" * 1000, "deflate", None)]


def built(spark, rows):
    return bytes(zip_write.archives(entries(spark, rows)).first()["content"])


def frame(spark, data):
    return spark.createDataFrame([("a", bytearray(data))], "archive string, content binary")


def test_written_archives_are_read_by_zipfile(spark):
    data = built(spark, SOME)
    with zipfile.ZipFile(io.BytesIO(data)) as f:
        assert f.testzip() is None
        assert [(i.filename, f.read(i)) for i in f.infolist()] == [(n, c) for n, c, _, _ in SOME]
        assert f.infolist()[2].comment == b"a note" and f.infolist()[0].date_time == (2024, 6, 15, 14, 30, 22)
        assert [i.compress_type for i in f.infolist()] == [0, 8, 8, 8]
    assert len(data) < 2000


def test_zipfile_archives_are_read(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        for k in range(30):
            f.writestr(zipfile.ZipInfo(f"p{k}.txt", (2000, 1, 1, 0, 0, 0)), b"x" * k, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    for read in (zip_read.entries, zip_read.scan):
        got = read(frame(spark, b"" + out.getvalue())).orderBy("ordinal").collect()
        assert [(r["name"], bytes(r["content"]), r["status"]) for r in got] == [(f"p{k}.txt", b"x" * k, "ok") for k in range(30)]
    streamed = io.BytesIO()

    class NoSeek(io.RawIOBase):
        def writable(self):
            return True

        def write(self, b):
            return streamed.write(b)

    with zipfile.ZipFile(NoSeek(), "w", zipfile.ZIP_DEFLATED) as f:  # data descriptors
        f.writestr("a", b"first" * 50)
        f.writestr("b", b"second")
    got = zip_read.scan(frame(spark, streamed.getvalue())).collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("a", b"first" * 50), ("b", b"second")]


def test_end_record():
    end = b"PK\x05\x06" + bytes(18)
    assert z.find_end(end) == 0 and z.find_end(b"j" * 100 + end) == 100 and z.find_end(end + b"junk") == 0
    assert z.find_end(end[:20] + b"\x05\x00" + b"hello") == 0
    assert z.find_end(end[:20] + b"\x05\x00" + b"hi") == -1 and z.find_end(b"") == -1
    assert zip_write.EMPTY_ARCHIVE == end and z.directory(22, lambda a, n: end[a : a + n]) == []
    for bad in (b"", b"x" * 1000):
        with pytest.raises(CorruptArchive):
            z.directory(len(bad), lambda a, n, bad=bad: bad[a : a + n])


def test_lookup_takes_the_last_of_a_name(spark):
    got = zip_read.lookup(zip_read.entries(frame(spark, built(spark, [("x", b"1", None, None), ("x", b"2", None, None), ("y", b"3", None, None)]))), "x").collect()
    assert [bytes(r["content"]) for r in got] == [b"2"]


def test_random_damage_is_never_silent(spark):
    data, r = built(spark, SOME), random.Random(4)
    want = [(n, c) for n, c, _, _ in SOME]
    rows = []
    for k in range(60):
        bad = bytearray(data)
        bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        rows.append((str(k), bad))
    got = zip_read.entries(spark.createDataFrame(rows, "archive string, content binary"), permissive=True).collect()
    assert {x["archive"] for x in got} == {str(k) for k in range(60)}
    for x in got:
        if x["status"] == "ok" and x["name"] in dict(want) and x["crc32"]:
            assert bytes(x["content"]) == dict(want)[x["name"]]
    cut = data[: len(data) // 2]
    with pytest.raises(Exception, match="end of central directory"):
        zip_read.entries(frame(spark, cut)).collect()


def test_statuses():
    data = b"hello"
    e = z.Entry(0, "n", 0, 1, 5, 5, 0, WHEN)
    assert z.decode(e, data)[1] == "crc_mismatch"
    e.crc32 = 0
    assert z.decode(e, data)[1] == "ok"
    e.uncompressed_size = 6
    assert z.decode(e, data)[1] == "size_mismatch"
    e.method = 99
    assert z.decode(e, data)[1] == "unsupported_method" and z.decode(e, b"hell")[1] == "truncated"
    e.method = 8
    assert z.decode(e, b"\xff" * 5)[1] == "corrupt"


def test_wide_fields():
    full = 0xFFFFFFFF
    extra = struct.pack("<HH2s", 9, 2, b"zz") + struct.pack("<HHQQ", 1, 16, 7, 8)
    assert z.wide_fields(extra, full, full, 5, "x") == (7, 8, 5)
    assert z.wide_fields(extra, 3, full, full, "x") == (3, 7, 8)
    for bad in (b"", extra[:8], struct.pack("<HHI", 1, 4, 1), struct.pack("<HHQ", 1, 8, 1 << 53)):
        with pytest.raises(CorruptArchive):
            z.wide_fields(bad, full, full, 0, "x")


def test_wide_fields_up_to_a_bigint():
    full, most = 0xFFFFFFFF, (1 << 63) - 1
    assert z.wide_fields(struct.pack("<HHQQ", 1, 16, 1 << 53, most), full, full, 0, "x", z.BIGINT) == (1 << 53, most, 0)
    with pytest.raises(CorruptArchive, match="of 2.63 or more"):
        z.wide_fields(struct.pack("<HHQ", 1, 8, 1 << 63), full, 0, 0, "x", z.BIGINT)
    end = struct.pack("<IQHHIIQQQQ", z.END64, 44, 45, 45, 0, 0, 1 << 53, 1 << 53, most, 5) + struct.pack("<IIQI", z.LOCATOR, 0, 0, 1) + struct.pack("<IHHHHIIH", z.END, 0, 0, z.FULL16, z.FULL16, full, full, 0)
    read = lambda a, n: end[a : a + n]
    assert z.directory_span(len(end), read, z.BIGINT) == (1 << 53, most, 5)
    with pytest.raises(CorruptArchive, match="of 2.53 or more"):
        z.directory_span(len(end), read)


def test_wide_headers_match_zipfile_rules(spark):
    big = (1 << 32) + 5
    row = spark.createDataFrame([("a", 0, bytearray(b"n"), bytearray(b""), 0, 1, big, big, big + 9, WHEN)], "archive string, ord bigint, raw_name binary, raw_comment binary, method int, crc32 bigint, csize bigint, usize bigint, local_header_offset bigint, last_modified timestamp_ntz")
    got = row.select(zip_write.local_header_hex().alias("l"), zip_write.central_hex().alias("c")).first()
    e = z.parse_directory(bytes.fromhex(got["c"]), 1)[0]
    assert (e.compressed_size, e.uncompressed_size, e.offset, e.name) == (big, big, big + 9, "n")
    assert len(got["l"]) // 2 == 30 + 1 + 20
    end = bytes.fromhex(spark.range(1).select(zip_write.end_hex(F.lit(70_000).cast("bigint"), F.lit(3).cast("bigint"), F.lit(0).cast("bigint"))).first()[0])
    assert len(end) == 98 and z.directory_span(3 + 98, lambda a, n: (b"abc" + end)[a : a + n]) == (70_000, 3, 0)


BAD = [("", b"x", None, None), ("n", None, None, None), (None, b"x", None, None), ("n" * 70_000, b"x", None, None), ("n", b"x", None, "c" * 70_000), ("n", b"x", "zip", None)]


@pytest.mark.parametrize("row", BAD)
def test_bad_entries_fail_wherever_they_are_written(spark, row, tmp_path):
    e = entries(spark, [SOME[1], row])
    with pytest.raises(BadEntry, match="name"):
        zip_write.check_entries(e)
    with pytest.raises(BadEntry, match="name"), typed_errors():
        zip_write.archives(e).collect()
    with pytest.raises(BadEntry, match="name"):
        pipe(memory.from_table(e, ["ord"], ["archive"]), lambda s: zip_write.archives(s.df).collect())
    zip_source.register(spark)
    with pytest.raises(BadEntry, match="name"), typed_errors():
        e.coalesce(1).write.format("strandzip").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in os.listdir(tmp_path / "out") if p.endswith(".zip")]


def test_good_entries_and_aborts(spark):
    zip_write.check_entries(entries(spark, SOME))
    with pytest.raises(ArchiveAborted):
        zip_write.archives(entries(spark, SOME), aborted=True)
    some = entries(spark, SOME).withColumn("aborted", F.col("name") == "all.bin")
    got = zip_read.entries(zip_write.archives(some)).orderBy("ordinal").collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [(n, c) for n, c, _, _ in SOME if n != "all.bin"]


def test_own_codec(spark):
    codec.register("backwards", 777, lambda b: b[::-1], lambda b: b[::-1])
    codec.register("oneway", 778, lambda b: b)
    for bad in (("deflate", 9), ("x", 8), ("x", 70_000), ("", 5)):
        with pytest.raises(ValueError):
            codec.register(*bad, bytes)
    data = built(spark, [("a", b"abc", "backwards", None), ("b", b"abc" * 99, None, None), ("c", b"xyz", "oneway", None)])
    got = zip_read.entries(frame(spark, data), permissive=True).orderBy("ordinal").collect()
    assert [(r["compression_method"], r["status"]) for r in got] == [(777, "ok"), (8, "ok"), (778, "unsupported_method")]
    assert bytes(got[0]["content"]) == b"abc" and b"cba" in data


def test_entries_are_compressed_once(spark):
    plan = zip_write.archives(entries(spark, SOME))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_close_of_a_reader(tmp_path):
    path = tmp_path / "a.zip"
    path.write_bytes(zip_write.EMPTY_ARCHIVE)
    with zip_source._File(str(path)) as f:
        assert z.directory(f.size, f.read) == [] and f.read(-1, 4) == b""
    with pytest.raises(ValueError):
        f.read(0, 4)


def test_data_source(spark, tmp_path):
    zip_source.register(spark)
    src = entries(spark, [(f"f{i:03}", b"x" * i, None, None) for i in range(50)]).coalesce(1)
    src.write.format("strandzip").mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("strandzip").option("path", str(tmp_path / "out/*.zip")).option("entries_per_partition", 7).load()
    assert got.rdd.getNumPartitions() == 8 and got.count() == 50
    one = spark.read.format("strandzip").option("path", str(tmp_path / "out/*.zip")).option("name", "f007").load().collect()
    assert [bytes(r["content"]) for r in one] == [b"x" * 7]
    names = spark.read.format("strandzip").option("path", str(tmp_path / "out/*.zip")).option("content", "false").load()
    assert "content" not in names.columns and names.count() == 50
    assert zip_read.entries(zip_read.from_files(spark, str(tmp_path / "out/*.zip"))).count() == 50
