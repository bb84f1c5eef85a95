"""A channel: one side pushes rows, the other is a streaming source.

A write lands as a file in a shared folder, which Structured Streaming reads with its own offsets, so a restarted query resumes where it
was. The folder must be one that the driver can write to and the executors read, such as a shared mount. `consume` reads while the
producer writes, in another thread of the driver: a producer with `in_flight` writes ahead of the consumer by that many and then waits,
an error wakes a consumer that waits, and a consumer that stops early ends the producer's writes.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import ChannelClosed
from ..plans.seq import track


class Channel:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, in_flight: int | None = None):
        if in_flight is not None and in_flight < 1:
            raise ValueError("in_flight must be at least 1")
        self.spark, self.path, self.schema, self.in_flight = spark, path, schema, in_flight
        self.closed, self.failure = False, None
        self.rows, self.ends, self.read = 0, [], 0  # rows written, the row count after each write, rows read
        self.change = threading.Condition()
        os.makedirs(path, exist_ok=True)

    def _unread(self) -> int:
        return sum(1 for end in self.ends if end > self.read)

    def write(self, rows: Iterable[dict], timeout: float | None = None) -> None:
        """Appends rows as one atomic file; refused after close, error or an early stop of the consumer. With `in_flight`, waits until fewer
        writes than that are unread, at most `timeout` seconds."""
        lines = [dict(r) for r in rows]
        with self.change:
            if self.in_flight is not None and not self.change.wait_for(lambda: self.closed or self._unread() < self.in_flight, timeout):
                raise TimeoutError("the consumer did not read in time")
            if self.closed:
                raise ChannelClosed("write after close")
            if not lines:
                return
            part = os.path.join(self.path, f"_{uuid.uuid4().hex}")
            with open(part, "w") as f:
                f.write("\n".join(json.dumps(r | {"ord": self.rows + i}, default=str) for i, r in enumerate(lines)))
            self.rows += len(lines)
            os.rename(part, os.path.join(self.path, f"{self.rows:012d}.json"))
            self.ends.append(self.rows)
            self.change.notify_all()

    def close(self) -> None:
        with self.change:
            self.closed = True
            self.change.notify_all()

    def error(self, e: Exception) -> None:
        """What was written before is read first; then the consumer gets this."""
        with self.change:
            self.closed, self.failure = True, self.failure or e
            self.change.notify_all()

    def source(self, max_files: int | None = None) -> DataFrame:
        """The reading side, with column ord for the order of writes."""
        schema = f"ord bigint, {self.schema}" if isinstance(self.schema, str) else StructType([StructField("ord", LongType()), *self.schema.fields])
        r = self.spark.readStream.schema(schema)
        return (r.option("maxFilesPerTrigger", max_files) if max_files else r).json(self.path)

    def drain(self, handle, checkpoint: str, max_files: int | None = None) -> None:
        """Hands every micro-batch that there is to handle(frame, id), in order, then raises the channel's error if it has one."""
        q = self.source(max_files).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        track(q).awaitTermination()
        if self.failure is not None:
            raise self.failure

    def consume(self, handle, checkpoint: str) -> None:
        """Hands each write to handle(frame, id) as it comes, until the channel is closed and read, or `handle` returns False, which ends
        the producer's writes. Then raises the channel's error if it has one."""
        stopped = []

        def each(df: DataFrame, i: int) -> None:
            if stopped:
                return
            if handle(df, i) is False:
                stopped.append(i)
                self.close()
            last = df.agg(F.max("ord")).first()[0]
            with self.change:
                self.read = max(self.read, 0 if last is None else last + 1)
                self.change.notify_all()

        q = track(self.source(1).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start())
        try:
            with self.change:
                while q.isActive and not stopped and not (self.closed and self.read >= self.rows):
                    self.change.wait(0.5)  # a query that failed wakes nobody
        finally:
            q.stop()
            self.close()
        if q.exception() is not None:
            raise q.exception()
        if self.failure is not None and not stopped:
            raise self.failure
