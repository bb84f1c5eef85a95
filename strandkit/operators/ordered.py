"""Operators on ordered sequences, each a declarative plan.

Keyed sequences are partitioned by their key, so state never meets in one task; a sequence without a key is one order by definition
and its windows run in one task, which suits small inputs: give large ones a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, NumericType, StructField, StructType

from ..errors import BufferOverflow
from ..plans.seq import Seq

Transform = Callable[[Seq], Seq]


def _positive(n: int, what: str) -> None:
    if n < 1:
        raise ValueError(f"{what} must be at least 1")


#: Rows up to which running sums take one window a key; more are summed in two levels.
ONE_LEVEL, SPANS = 1_000_000, 256


def tap(observation: Observation | None = None, running: dict[str, Column] | None = None, *metrics: Column) -> Transform:
    """Watches without changing rows: metrics go to an Observation when the plan runs; `running` adds aggregates up to each row.
    Running sums over large keys: running_sum."""

    def apply(s: Seq) -> Seq:
        df = s.df
        if observation is not None:
            df = df.observe(observation, *metrics)
        for name, agg in (running or {}).items():
            df = df.withColumn(name, agg.over(s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return s.with_df(df)

    return apply


def running_sum(name: str, value: Column, one_level: int = ONE_LEVEL) -> Transform:
    """Adds the sum of a bigint column up to and with each row, null where no row had a value yet.

    A key's rows are dealt over spans of the first order column, which must be a number; sums within spans and over the spans before
    make the whole, so a key that holds most rows is spread over tasks. The span limits are quantiles from one small job; up to
    `one_level` rows the same sums come from one window.
    """

    def apply(s: Seq) -> Seq:
        by = s.window()
        first = s.order_by[0]
        if not isinstance(s.df.schema[first].dataType, NumericType):
            return s.with_df(s.df.withColumn(name, F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))))
        got = s.df.agg(F.count("*").alias("n"), F.percentile_approx(first, [k / SPANS for k in range(1, SPANS)], 10 * SPANS).alias("cuts")).first()
        if got["n"] <= one_level:
            return s.with_df(s.df.withColumn(name, F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))))
        cuts = F.array(*[F.lit(c) for c in sorted(set(got["cuts"] or []))])
        spans = s.df.withColumn("__value", value).withColumn("__span", F.size(F.filter(cuts, lambda c: c <= F.col(first))))
        within = Window.partitionBy(*s.key, "__span").orderBy(*s.order_by).rowsBetween(Window.unboundedPreceding, 0)
        sums = spans.groupBy(*s.key, "__span").agg(F.sum("__value").alias("__n"))
        before = Window.partitionBy(*s.key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(s.key)], F.col("__span").alias("__s"), F.sum("__n").over(before).alias("__before"))
        on = F.col("__span") == F.col("__s")
        for i, k in enumerate(s.key):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        rows = spans.withColumn("__run", F.sum("__value").over(within)).join(sums, on)
        total = F.when(F.col("__before").isNull(), F.col("__run")).otherwise(F.col("__before") + F.coalesce("__run", F.lit(0)))
        return s.with_df(rows.select(*s.df.columns, total.alias(name)))

    return apply


def finalize(f: Callable[[], object]) -> Transform:
    """Runs f once when the pipeline ends: on success, failure or an early stop."""
    return lambda s: Seq(s.df, s.order_by, s.key, (*s.finalizers, f))


def abortable(signal: Column) -> Transform:
    """Keeps each sequence up to and including its first row with the signal: the row being handled when it fires was delivered.
    A null signal does not fire."""

    def apply(s: Seq) -> Seq:
        fired = F.max(F.coalesce(signal.cast("int"), F.lit(0))).over(s.window().rowsBetween(Window.unboundedPreceding, -1))
        return s.with_df(s.df.withColumn("__fired", fired).where(F.coalesce("__fired", F.lit(0)) == 0).drop("__fired"))

    return apply


def batch(n: int, columns: list[str] | None = None) -> Transform:
    """Arrays of n rows in order, the rest last; nothing for no rows. Adds batch_id (from 0), items and batch_size."""
    _positive(n, "batch size")

    def apply(s: Seq) -> Seq:
        got = columns or [c for c in s.df.columns if c not in s.key]
        df = s.df.withColumn("batch_id", F.floor((F.row_number().over(s.window()) - 1) / n))
        item = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(s.order_by)], F.struct(*got).alias("row"))
        df = df.groupBy(*s.key, "batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("batch_size"))
        return s.with_df(df.withColumn("items", F.transform("items", lambda x: x["row"])), order_by=("batch_id",))

    return apply


def batch_numbers(n: int, wait_ms: int, time: str, name: str = "batch_id") -> Transform:
    """Numbers rows by batches that end at n rows or `wait_ms` after their first; a row exactly at the deadline opens the next.

    The fold is sequential within a key and keeps three numbers, so it streams over each key's sorted rows with constant memory,
    whatever the key's size. Rows stay in Arrow, so values keep their type; a null key is a key like others. A row without a time
    meets no deadline, and a batch's deadline counts from its first row that has one.
    """
    _positive(n, "batch size")
    _positive(wait_ms, "wait")

    def apply(s: Seq) -> Seq:
        schema = StructType([*s.df.schema.fields, StructField(name, LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, began, number = 0, None, -1
            for rows in batches:
                out = []
                for opens, t in zip(rows.column("__opens").to_pylist(), rows.column("__ms").to_pylist()):
                    if opens:
                        size, number = 0, -1
                    if size == 0 or size >= n or (began is not None and t is not None and t >= began + wait_ms):
                        number, size, began = number + 1, 0, None
                    began = t if began is None else began
                    size += 1
                    out.append(number)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-2], pa.array(out, pa.int64())], names=[*rows.schema.names[:-2], name])

        # the window deals and sorts the rows, and tells where a key begins
        df = s.df.withColumn("__opens", F.row_number().over(s.window()) == 1).withColumn("__ms", F.unix_millis(F.col(time).cast("timestamp")))
        return s.with_df(df.mapInArrow(run, schema))

    return apply


def batch_timed(n: int, wait_ms: int, time: str, columns: list[str] | None = None) -> Transform:
    """Like batch, with a batch also ending `wait_ms` after its first row, by the event time column."""

    def apply(s: Seq) -> Seq:
        got = columns or [c for c in s.df.columns if c not in s.key]
        df = batch_numbers(n, wait_ms, time)(s).df
        item = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(s.order_by)], F.struct(*got).alias("row"))
        df = df.groupBy(*s.key, "batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("batch_size"))
        return s.with_df(df.withColumn("items", F.transform("items", lambda x: x["row"])), order_by=("batch_id",))

    return apply


def _nothing() -> Seq:
    """A sequence without rows, as sources.memory.empty gives it; an item has no type yet."""
    return Seq(SparkSession.active().createDataFrame([], "ord bigint, item void"), ("ord",))


def merge(*sources: Seq) -> Seq:
    """All rows of all sources, as a bag: the order is undefined by contract. One source passes through; none gives nothing."""
    if not sources:
        return _nothing()
    if len(sources) == 1:
        return sources[0]
    df = sources[0].df
    for s in sources[1:]:
        df = df.unionByName(s.df)
    return Seq(df, None, sources[0].key, tuple(f for s in sources for f in s.finalizers))


def concat(*sources: Seq) -> Seq:
    """The sources one after another; src_ord comes first in the order. All must name their order columns alike. None gives nothing."""
    if not sources:
        return _nothing()
    if len({s.order_by for s in sources}) > 1 or sources[0].order_by is None:
        raise ValueError("concat needs sources with the same order columns")
    df = None
    for i, s in enumerate(sources):
        part = s.df.withColumn("src_ord", F.lit(i))
        df = part if df is None else df.unionByName(part)
    return Seq(df, ("src_ord", *sources[0].order_by), sources[0].key, tuple(f for s in sources for f in s.finalizers))


def flat_map(items: Column, name: str = "value", concurrency: int = 1) -> Transform:
    """Expands every row to the items of an array column. Sequential: ordered by row, then item. Concurrent: the same bag, order undefined;
    how many tasks run at once is the cluster's to decide."""
    _positive(concurrency, "concurrency")

    def apply(s: Seq) -> Seq:
        if isinstance(s.df.select(items.alias("x")).schema[0].dataType, ArrayType) is False:
            raise TypeError("flat_map needs an array column")
        df = s.df.select("*", F.posexplode(items).alias("inner_ord", name))
        if concurrency == 1:
            return s.with_df(df, order_by=(*(s.order_by or ()), "inner_ord"))
        return s.with_df(df, order_by=None)

    return apply


def flat_map_table(inner: Seq, on: list[str], concurrency: int = 1) -> Transform:
    """Expands every row to the matching rows of another sequence."""
    _positive(concurrency, "concurrency")

    def apply(s: Seq) -> Seq:
        df = s.df.join(inner.df, on)
        return s.with_df(df, order_by=(*(s.order_by or ()), *(inner.order_by or ())) if concurrency == 1 else None)

    return apply


def buffer(n: int, strategy: str = "suspend", burst: list[str] | None = None, deliver: bool = False) -> Transform:
    """A bounded buffer between a producer and a consumer, for bursts: all rows of a burst come before the consumer drains any.

    suspend loses nothing; drop keeps the first n of a burst, slide the last n; error fails the query when a burst has more. With
    `deliver`, error first hands on the rows that came before the overflow, and the pipeline fails at its end, with BufferOverflow.
    """
    _positive(n, "buffer size")
    if strategy not in ("suspend", "drop", "slide", "error"):
        raise ValueError(f"no such strategy: {strategy}")
    said = f"Buffer overflow: capacity {n} exceeded"

    def apply(s: Seq) -> Seq:
        if strategy == "suspend":
            return s
        by = Window.partitionBy(*s.key, *(burst or []))
        if strategy == "error" and deliver:

            def check() -> None:
                if overflows(s, n, burst or []).limit(1).count():
                    raise BufferOverflow(said)

            rows = s.df.withColumn("__over", (F.row_number().over(by.orderBy(*s.order_by)) > n).cast("int"))
            rows = rows.withColumn("__over", F.max("__over").over(s.window().rowsBetween(Window.unboundedPreceding, 0)))
            return Seq(rows.where("__over = 0").drop("__over"), s.order_by, s.key, (*s.finalizers, check))
        if strategy == "error":
            over = F.count("*").over(by) > n
            fail = F.when(over, F.raise_error(F.lit(f"BufferOverflow: {said}")).cast("boolean")).otherwise(True)
            return s.with_df(s.df.withColumn("__ok", fail).where("__ok").drop("__ok"))
        order = [F.col(c).asc() if strategy == "drop" else F.col(c).desc() for c in s.order_by]
        return s.with_df(s.df.withColumn("__rn", F.row_number().over(by.orderBy(*order))).where(F.col("__rn") <= n).drop("__rn"))

    return apply


def overflows(s: Seq, n: int, burst: list[str]) -> DataFrame:
    """The bursts that a buffer of n rows could not hold, with their sizes."""
    return s.df.groupBy(*s.key, *burst).agg(F.count("*").alias("n")).where(F.col("n") > n)
