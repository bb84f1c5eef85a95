import threading
import time

import pytest

from strandkit.errors import ChannelClosed
from strandkit.streaming.channel import Channel
from strandkit.streaming.timed_batch import batch_timed_stream


def test_channel(spark, tmp_path):
    c = Channel(spark, str(tmp_path / "c"), "item bigint")
    c.write([{"item": 1}, {"item": 2}])
    c.write([{"item": 3}])
    c.close()
    with pytest.raises(ChannelClosed):
        c.write([{"item": 4}])
    seen = []
    c.drain(lambda df, _: seen.extend((r["ord"], r["item"]) for r in df.collect()), str(tmp_path / "k"), max_files=1)
    assert sorted(seen) == [(0, 1), (1, 2), (2, 3)]


def test_channel_error_comes_after_what_was_written(spark, tmp_path):
    c = Channel(spark, str(tmp_path / "c"), "item bigint")
    c.write([{"item": 1}])
    c.error(RuntimeError("late"))
    seen = []
    with pytest.raises(RuntimeError, match="late"):
        c.drain(lambda df, _: seen.extend(r["item"] for r in df.collect()), str(tmp_path / "k"))
    assert seen == [1]


@pytest.mark.parametrize(("kind", "of"), [("bigint", int), ("string", str)])
def test_timed_batches_on_a_stream(spark, tmp_path, kind, of):
    c = Channel(spark, str(tmp_path / "c"), f"k string, item {kind}")
    c.write([{"k": "a", "item": of(i)} for i in range(5)])
    out = batch_timed_stream(c.source(), 2, 60_000, "k", "item")
    q = out.writeStream.format("memory").queryName(f"timed_{kind}").option("checkpointLocation", str(tmp_path / "k")).outputMode("append").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table(f"timed_{kind}").count() < 2 and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted(spark.table(f"timed_{kind}").collect(), key=lambda r: r["batch_id"])
    assert [len(r["items"]) for r in got][:2] == [2, 2]  # the fifth item waits for its timer
    assert sorted(r["batch_id"] for r in got) == list(range(len(got)))
    assert {type(x) for r in got for x in r["items"]} == {of}
    assert len({x for r in got for x in r["items"]}) == sum(len(r["items"]) for r in got) >= 4


def test_consume_while_the_producer_writes_and_waits(spark, tmp_path):
    c = Channel(spark, str(tmp_path / "c"), "item bigint", in_flight=1)
    seen, writes = [], []

    def produce():
        for i in range(4):
            c.write([{"item": i}], timeout=60)
            writes.append((i, len(seen)))
        c.close()

    t = threading.Thread(target=produce)
    t.start()
    c.consume(lambda df, _: seen.extend(r["item"] for r in df.collect()), str(tmp_path / "k"))
    t.join(60)
    assert seen == [0, 1, 2, 3] and all(n >= i for i, n in writes)  # no write went ahead of the reads by more than one
    with pytest.raises(ChannelClosed):
        c.write([{"item": 9}])


def test_a_consumer_that_stops_ends_the_writes(spark, tmp_path):
    c = Channel(spark, str(tmp_path / "c"), "item bigint", in_flight=1)
    refused = []

    def produce():
        try:
            for i in range(50):
                c.write([{"item": i}], timeout=60)
        except ChannelClosed:
            refused.append(i)

    t = threading.Thread(target=produce)
    t.start()
    c.consume(lambda df, _: False, str(tmp_path / "k"))
    t.join(60)
    assert refused and refused[0] <= 3


def test_an_error_wakes_a_waiting_consumer(spark, tmp_path):
    c = Channel(spark, str(tmp_path / "c"), "item bigint")
    t = threading.Timer(1.0, lambda: c.error(RuntimeError("delayed")))
    t.start()
    with pytest.raises(RuntimeError, match="delayed"):
        c.consume(lambda df, _: None, str(tmp_path / "k"))
    slow = Channel(spark, str(tmp_path / "s"), "item bigint", in_flight=1)
    slow.write([{"item": 1}])
    with pytest.raises(TimeoutError):
        slow.write([{"item": 2}], timeout=0.2)
    with pytest.raises(ValueError):
        Channel(spark, str(tmp_path / "s"), "item bigint", in_flight=0)
