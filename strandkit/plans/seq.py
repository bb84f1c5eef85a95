"""Ordered frames and their composition.

A DataFrame is a multiset; a Seq adds the columns that make its order total. Operators take and return Seqs, so a plan stays one
declarative DataFrame until a sink runs it. `order_by=None` says that the order is undefined by contract, as after a merge.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window

from ..errors import typed


@dataclass(frozen=True)
class Seq:
    df: DataFrame
    order_by: tuple[str, ...] | None
    #: Columns within which order and state are kept; none: one sequence.
    key: tuple[str, ...] = ()
    #: Run when the pipeline ends, however it ends; the last added first.
    finalizers: tuple[Callable[[], Any], ...] = field(default=())

    def __post_init__(self) -> None:
        missing = [c for c in (*self.key, *(self.order_by or ())) if c not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")

    def window(self):
        """The sequence's order as a window; refused where the order is undefined."""
        if not self.order_by:
            raise ValueError("the order of this sequence is undefined; give it one first")
        return Window.partitionBy(*self.key).orderBy(*self.order_by)

    def with_df(self, df: DataFrame, **change) -> Seq:
        return Seq(df, change.get("order_by", self.order_by), change.get("key", self.key), self.finalizers)

    def then(self, f: Callable[[Seq], Seq]) -> Seq:
        return f(self)

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Seq:
        """A projection or filter; it must keep the key and order columns."""
        return self.with_df(f(self.df))


#: The streaming queries of the pipelines that are running here, the innermost pipeline last.
_RUNNING: ContextVar[tuple[list, ...]] = ContextVar("running", default=())


def track(query: Any) -> Any:
    """Hands a streaming query, or anything with stop(), to the pipeline that is running, which stops it when it ends. Returns it.
    Outside of a pipeline nothing is tracked."""
    if _RUNNING.get():
        _RUNNING.get()[-1].append(query)
    return query


def pipe(source: Seq, *stages: Callable) -> Any:
    """Composes transforms and runs the sink, which comes last; returns the sink's value.

    Building the plan runs nothing, so errors of construction surface at once. When the sink ends, fails or stops early, the streaming
    queries it tracked are stopped, then every finalizer runs, those nearest to the sink first. The sink's error is the one that is seen: errors of finalizers are attached
    to it as notes and in `suppressed`; if only finalizers fail, the first of their errors is raised with the others attached.
    """
    if not stages:
        raise TypeError("pipe needs a sink")
    *transforms, sink = stages
    seq = source
    for t in transforms:
        seq = t(seq)
    primary: BaseException | None = None
    value = None
    started: list = []
    token = _RUNNING.set((*_RUNNING.get(), started))
    try:
        value = sink(seq)
    except BaseException as e:  # noqa: BLE001
        primary = typed(e)
        if primary is not e:
            primary.__cause__ = e
    finally:
        _RUNNING.reset(token)
    others: list[BaseException] = []
    for f in (*(q.stop for q in reversed(started)), *reversed(seq.finalizers)):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            others.append(e)
    if primary is None and others:
        primary, others = others[0], others[1:]
    if primary is not None:
        if others:
            primary.suppressed = others
            for e in others:
                primary.add_note(f"suppressed: {e!r}")
        raise primary
    return value
