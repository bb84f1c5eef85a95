"""Sources from tables and literals, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.seq import Seq, track


def from_table(df: DataFrame, order_by: list[str], key: list[str] | None = None) -> Seq:
    """A frame whose `order_by` columns, within `key`, make a total order."""
    return Seq(df, tuple(order_by), tuple(key or ()))


def from_rows(spark: SparkSession, rows: Iterable[Any], kind: str) -> Seq:
    """A driver-side iterable as (ord, item). `kind` is the item's type, such as `bigint`. A string gives its characters."""
    data = [(i, x) for i, x in enumerate(rows)]
    return Seq(spark.createDataFrame(data, f"ord bigint, item {kind}"), ("ord",))


def of(spark: SparkSession, *items: Any, kind: str = "bigint") -> Seq:
    """The literals in order, as a local relation inside the plan."""
    if not items:
        return empty(spark, kind)
    values = F.array(*[F.lit(x).cast(kind) for x in items])
    return Seq(spark.range(1).select(F.posexplode(values).alias("ord", "item")).select(F.col("ord").cast("bigint").alias("ord"), "item"), ("ord",))


def empty(spark: SparkSession, kind: str = "bigint") -> Seq:
    return Seq(spark.createDataFrame([], f"ord bigint, item {kind}"), ("ord",))


def collect() -> Callable[[Seq], list[Row]]:
    """All rows in order."""
    return lambda s: (s.df.orderBy(*s.key, *s.order_by) if s.order_by else s.df).collect()


def collect_bytes(column: str = "item") -> Callable[[Seq], bytes]:
    """The binary items joined in order; zero bytes for no items. Null items add nothing. They are joined as hex: within 1 GiB."""

    def sink(s: Seq) -> bytes:
        return bytes(s.df.agg(joined(column, s.order_by).alias("b")).first()["b"])

    return sink


def joined(column: str, order_by: tuple[str, ...] | list[str]):
    """An aggregate: the binary column joined in order; zero bytes for an empty group."""
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_by], F.col(column).alias("__b"))))
    parts = F.transform(pairs, lambda x: F.coalesce(x["__b"], F.lit(b"")))
    # hex text joins in linear time where a fold over binary would copy the whole at every step
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))


def count() -> Callable[[Seq], int]:
    return lambda s: s.df.count()


def fold(*aggregates) -> Callable[[Seq], Row]:
    """Reduces to one row of aggregate columns."""
    return lambda s: s.df.agg(*aggregates).first()


def take(n: int) -> Callable[[Seq], list[Row]]:
    """Stops after n rows."""
    return lambda s: s.df.orderBy(*s.key, *s.order_by).limit(n).collect()


def to_stream() -> Callable[[Seq], Iterator[Row]]:
    """Rows pulled partition by partition; a consumer that stops early leaves the rest unread."""
    return lambda s: (s.df.orderBy(*s.key, *s.order_by) if s.order_by else s.df).toLocalIterator(prefetchPartitions=False)


def write_to(open_writer: Callable[[int], Any], checkpoint: str | None = None) -> Callable[[Seq], None]:
    """Each partition opens a writer with write, close and abort: closed on success, aborted on failure, the error raised again.

    A streaming sequence is written until what there is has been read, with a writer for each partition of each micro-batch; a later
    run with the same `checkpoint` goes on from there. A retried task opens a writer again, so a writer should replace what its
    partition wrote before.
    """

    def sink(s: Seq) -> None:
        if s.df.isStreaming:
            w = s.df.writeStream.foreach(_Rows(open_writer)).trigger(availableNow=True)
            track((w.option("checkpointLocation", checkpoint) if checkpoint else w).start()).awaitTermination()
            return
        df = s.df.repartitionByRange(*s.order_by).sortWithinPartitions(*s.order_by) if s.order_by else s.df

        def run(rows: Iterator[Row]) -> None:
            from pyspark import TaskContext

            w = open_writer(TaskContext.get().partitionId())
            try:
                for r in rows:
                    w.write(r)
            except BaseException:
                w.abort()
                raise
            w.close()

        df.foreachPartition(run)

    return sink


class _Rows:
    """A writer as Spark's streaming sink drives it."""

    def __init__(self, open_writer: Callable[[int], Any]):
        self.open_writer = open_writer

    def open(self, partition: int, epoch: int) -> bool:
        self.w = self.open_writer(partition)
        return True

    def process(self, row: Row) -> None:
        self.w.write(row)

    def close(self, error: Exception | None) -> None:
        if error is None:
            self.w.close()
        else:
            self.w.abort()
