import os

import pytest
from pyspark.sql import functions as F

from strandkit.errors import BufferOverflow
from strandkit.operators import abortable, batch, batch_timed, buffer, concat, finalize, flat_map, merge, running_sum, tap
from strandkit.plans import Seq, pipe, track
from strandkit.sources import memory


def items(rows):
    return [r["item"] for r in rows]


def test_sources_and_sinks(spark):
    assert items(pipe(memory.of(spark, 1, 2, 3), memory.collect())) == [1, 2, 3]
    assert pipe(memory.of(spark, 1, 2, 3), memory.count()) == 3
    assert pipe(memory.empty(spark), memory.collect()) == []
    assert items(pipe(memory.from_rows(spark, "abc", "string"), memory.collect())) == ["a", "b", "c"]
    assert items(pipe(memory.of(spark, 5, 6, 7), memory.take(2))) == [5, 6]
    assert items(memory.to_stream()(memory.of(spark, 1, 2))) == [1, 2]
    chunks = memory.from_rows(spark, [b"\x01\x02", b"\x03", b"\x04\x05\x06"], "binary")
    assert pipe(chunks, memory.collect_bytes()) == bytes([1, 2, 3, 4, 5, 6])
    assert pipe(memory.empty(spark, "binary"), memory.collect_bytes()) == b""


def test_transforms_compose(spark):
    double = lambda s: s.map(lambda df: df.withColumn("item", F.col("item") * 2))
    assert items(pipe(memory.of(spark, 1, 2, 3), double, memory.collect())) == [2, 4, 6]


@pytest.mark.parametrize(("n", "want"), [(2, [[1, 2], [3, 4], [5]]), (1, [[1], [2], [3], [4], [5]]), (9, [[1, 2, 3, 4, 5]])])
def test_batch(spark, n, want):
    got = pipe(memory.of(spark, 1, 2, 3, 4, 5), batch(n, ["item"]), memory.collect())
    assert [[x["item"] for x in r["items"]] for r in got] == want


def test_batch_of_nothing_and_bad_sizes(spark):
    assert pipe(memory.empty(spark), batch(3), memory.collect()) == []
    for bad in (0, -1):
        with pytest.raises(ValueError):
            batch(bad)
        with pytest.raises(ValueError):
            buffer(bad)


def timed(spark, ms):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ms)], "ord bigint, ms bigint, item bigint").withColumn("at", F.timestamp_millis("ms"))
    return memory.from_table(df.drop("ms"), ["ord"])


@pytest.mark.parametrize(
    ("ms", "n", "wait", "want"),
    [
        ([0, 1, 2, 3, 4], 2, 5000, [[0, 1], [2, 3], [4]]),
        ([0, 60, 120, 180, 240], 10, 25, [[0], [1], [2], [3], [4]]),
        ([0, 10, 25, 49, 50], 10, 25, [[0, 1], [2, 3], [4]]),  # an item at the deadline opens a batch; the clock does not start again
    ],
)
def test_batch_timed(spark, ms, n, wait, want):
    got = pipe(timed(spark, ms), batch_timed(n, wait, "at", ["item"]), memory.collect())
    assert [[x["item"] for x in r["items"]] for r in got] == want


def test_batch_timed_keeps_null_and_wide_keys_and_values(spark):
    wide = 2**53 + 1
    rows = [(None, i, i * 10, wide + i) for i in range(5)] + [(wide, i, i * 10, None) for i in range(3)] + [(wide - 1, 0, None, 1), (wide - 1, 1, 0, 2), (wide - 1, 2, 7, 3)]
    df = spark.createDataFrame(rows, "k bigint, ord bigint, ms bigint, item bigint").withColumn("at", F.timestamp_millis("ms")).drop("ms")
    got = batch_timed(2, 5000, "at", ["item"])(memory.from_table(df, ["ord"], ["k"])).df.collect()
    assert sorted((r["k"] or 0, r["batch_id"], [x["item"] for x in r["items"]]) for r in got) == [
        (0, 0, [wide, wide + 1]), (0, 1, [wide + 2, wide + 3]), (0, 2, [wide + 4]), (wide - 1, 0, [1, 2]), (wide - 1, 1, [3]), (wide, 0, [None, None]), (wide, 1, [None]),
    ]
    late = batch_timed(9, 5, "at", ["item"])(memory.from_table(df.where(F.col("k") == wide - 1), ["ord"], ["k"])).df.collect()
    assert sorted((r["batch_id"], [x["item"] for x in r["items"]]) for r in late) == [(0, [1, 2]), (1, [3])]  # the clock starts at the first time


def test_running_sum_in_spans_equals_one_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"), (F.col("id") * 7919 % 3001).alias("ord"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("n"))
    s = memory.from_table(df, ["ord"], ["k"])
    one, two = (sorted(map(str, running_sum("sum", F.col("n"), one_level=m)(s).df.collect())) for m in (10**6, 0))
    assert one == two and len(one) == 3000
    assert running_sum("sum", F.col("n"), one_level=-1)(s.map(lambda d: d.limit(0))).df.count() == 0


def test_merge_and_concat(spark):
    a, b = memory.of(spark, 1, 2, 3), memory.of(spark, 4, 5)
    m = merge(a, b)
    assert m.order_by is None and sorted(items(pipe(m, memory.collect()))) == [1, 2, 3, 4, 5]
    assert merge(a) is a
    assert pipe(merge(), memory.collect()) == pipe(concat(), memory.collect()) == []
    failing = memory.of(spark, 1).map(lambda df: df.withColumn("item", F.raise_error(F.lit("second failed")).cast("bigint")))
    for both in (concat(a, failing), merge(a, failing)):
        with pytest.raises(Exception, match="second failed"):
            pipe(both, memory.collect())
    assert items(pipe(concat(a, memory.empty(spark), b), memory.collect())) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        m.window()


def test_flat_map(spark):
    expand = F.array(F.col("item"), F.col("item") * 10)
    got = pipe(memory.of(spark, 1, 2, 3), flat_map(expand), memory.collect())
    assert [r["value"] for r in got] == [1, 10, 2, 20, 3, 30]
    free = flat_map(expand, concurrency=3)(memory.of(spark, 1, 2, 3))
    assert free.order_by is None and sorted(r["value"] for r in pipe(free, memory.collect())) == [1, 2, 3, 10, 20, 30]
    assert pipe(memory.of(spark, 1), flat_map(F.array().cast("array<int>")), memory.collect()) == []
    with pytest.raises(ValueError):
        flat_map(expand, concurrency=0)
    inner = F.when(F.col("item") == 2, F.raise_error(F.lit("inner failed")).cast("array<bigint>")).otherwise(expand)
    with pytest.raises(Exception, match="inner failed"):
        pipe(memory.of(spark, 1, 2, 3), flat_map(inner), memory.collect())


def test_abortable(spark):
    s = memory.of(spark, *range(8))
    assert items(pipe(s, abortable(F.col("item") == 3), memory.collect())) == [0, 1, 2, 3]
    assert items(pipe(s, abortable(F.lit(None).cast("boolean")), memory.collect())) == list(range(8))


def test_buffer(spark):
    df = spark.createDataFrame([(i, i // 4, i) for i in range(6)], "ord bigint, burst bigint, item bigint")
    s = memory.from_table(df, ["ord"])
    assert items(pipe(s, buffer(3, "suspend", ["burst"]), memory.collect())) == [0, 1, 2, 3, 4, 5]
    assert items(pipe(s, buffer(3, "drop", ["burst"]), memory.collect())) == [0, 1, 2, 4, 5]
    assert items(pipe(s, buffer(3, "slide", ["burst"]), memory.collect())) == [1, 2, 3, 4, 5]
    assert len(pipe(s, buffer(4, "error", ["burst"]), memory.collect())) == 6
    with pytest.raises(BufferOverflow, match="Buffer overflow: capacity 3 exceeded"):
        pipe(s, buffer(3, "error", ["burst"]), memory.collect())
    seen = []
    with pytest.raises(BufferOverflow, match="capacity 3 exceeded"):
        pipe(s, buffer(3, "error", ["burst"], deliver=True), lambda q: seen.extend(items(memory.collect()(q))))
    assert seen == [0, 1, 2]
    assert len(pipe(s, buffer(4, "error", ["burst"], deliver=True), memory.collect())) == 6


def writer():
    class Writer:
        """Keeps what it is given in a file a partition; aborted, none."""

        def __init__(self, folder, partition):
            self.path, self.rows = f"{folder}/{partition}", []

        def write(self, row):
            if row["item"] == 13:
                raise ValueError("no thirteen")
            self.rows.append(row["item"])

        def close(self):
            with open(self.path, "w") as f:
                f.write(",".join(map(str, self.rows)))

        def abort(self):
            with open(self.path + ".aborted", "w") as f:
                f.write("")

    return Writer  # a class of a function travels to the workers by value


def written(folder):
    return sorted(int(x) for p in os.listdir(folder) if p.isdigit() for x in open(f"{folder}/{p}").read().split(",") if x)


def test_write_to(spark, tmp_path):
    Writer = writer()  # noqa: N806
    folder = str(tmp_path)
    pipe(memory.of(spark, 1, 2, 3, 4), memory.write_to(lambda k: Writer(folder, k)))
    assert written(folder) == [1, 2, 3, 4]
    bad = tmp_path / "bad"
    bad.mkdir()
    with pytest.raises(Exception, match="no thirteen"):
        pipe(memory.of(spark, 13), memory.write_to(lambda k: Writer(str(bad), k)))
    assert written(bad) == [] and any(p.endswith(".aborted") for p in os.listdir(bad))


def test_write_to_from_a_stream(spark, tmp_path):
    Writer = writer()  # noqa: N806
    for name in ("in", "out", "bad"):
        (tmp_path / name).mkdir()
    spark.range(20).selectExpr("id AS ord", "id AS item").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = Seq(spark.readStream.schema("ord bigint, item bigint").parquet(str(tmp_path / "in")), ("ord",))
    with pytest.raises(Exception, match="no thirteen"):
        pipe(s, memory.write_to(lambda k: Writer(str(tmp_path / "bad"), k), str(tmp_path / "k1")))
    assert any(p.endswith(".aborted") for p in os.listdir(tmp_path / "bad"))
    pipe(s.map(lambda df: df.where("item != 13")), memory.write_to(lambda k: Writer(str(tmp_path / "out"), k), str(tmp_path / "k2")))
    assert written(tmp_path / "out") == [i for i in range(20) if i != 13]


def test_pipe_stops_the_streaming_queries_it_tracked(spark, tmp_path):
    started = []

    def sink(s):
        started.append(track(s.df.writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()))
        raise KeyError("sink")

    with pytest.raises(KeyError):
        pipe(Seq(spark.readStream.format("rate").load(), ("timestamp",)), sink)
    assert not started[0].isActive
    assert track("outside") == "outside"


def test_tap(spark):
    from pyspark.sql import Observation

    seen = Observation()
    s = tap(seen, {"so_far": F.sum("item")}, F.sum("item").alias("total"))(memory.of(spark, 1, 2, 3, 4, 5))
    assert [r["so_far"] for r in pipe(s, memory.collect())] == [1, 3, 6, 10, 15] and seen.get["total"] == 15


def test_finalizers_and_errors(spark):
    ran = []

    def boom(text):
        def f():
            ran.append(text)
            raise RuntimeError(text)

        return f

    assert pipe(memory.of(spark, 1), finalize(lambda: ran.append("end")), memory.count()) == 1 and ran == ["end"]
    ran.clear()

    def fail(_):
        raise KeyError("primary")

    with pytest.raises(KeyError, match="primary") as e:
        pipe(memory.of(spark, 1), finalize(boom("a")), finalize(boom("b")), fail)
    assert ran == ["b", "a"] and [str(x) for x in e.value.suppressed] == ["b", "a"]
    with pytest.raises(RuntimeError, match="only"):
        pipe(memory.of(spark, 1), finalize(boom("only")), memory.count())
