"""Count-or-time batches on a stream, as a stateful processor with processing-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def processor(n: int, wait_ms: int, by: str, item: str, kind: str = "bigint"):
    """A batch ends at n items or wait_ms after its first; the rest of a key stays in state until its timer fires."""

    class TimedBatch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.items = handle.getListState("items", f"{item} {kind}")
            self.number = handle.getValueState("number", "n bigint")

        def _emit(self, k, items: list) -> pd.DataFrame:
            i = self.number.get()[0] if self.number.exists() else 0
            self.number.update((i + 1,))
            return pd.DataFrame({by: [k[0]], "batch_id": [i], "items": [items]})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = [x[0] for x in self.items.get()] if self.items.exists() else []
            had = bool(held)
            for frame in rows:
                for v in frame[item]:
                    held.append(v.item() if hasattr(v, "item") else v)
                    if len(held) >= n:
                        yield self._emit(key, held)
                        held, had = [], False
                        self._stop_timers()
            if held:
                self.items.put([(v,) for v in held])
                if not had:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait_ms)
            else:
                self.items.clear()

        def _stop_timers(self) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = [x[0] for x in self.items.get()] if self.items.exists() else []
            self.items.clear()
            if held:
                yield self._emit(key, held)

        def close(self) -> None:
            pass

    return TimedBatch()


def batch_timed_stream(df: DataFrame, n: int, wait_ms: int, key: str, item: str) -> DataFrame:
    """key, batch_id, items, for a stream of items of a numeric or string type that are not null. Needs the RocksDB state store provider."""
    kinds = dict(df.dtypes)
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor(n, wait_ms, key, item, kinds[item]),
        outputStructType=f"{key} {kinds[key]}, batch_id bigint, items array<{kinds[item]}>",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def micro_batch(df: DataFrame, handle, checkpoint: str) -> None:
    """Runs what there is and returns."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
