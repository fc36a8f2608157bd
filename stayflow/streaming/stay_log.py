"""The log of stays whose events arrive over time and out of order: numbered events and gap tokens, kept as state by stay.

An event waits until the watermark has passed its time, when nothing before it can arrive any more. Then it leaves, in the
total order of the log, with its number and, if a minute or more went by since the event before, a gap token before it.
State holds a stay's waiting events, the number and time of the last one that left, and one timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stayflow.functions import constants as C
from stayflow.functions.expressions import from_micros, micros
from stayflow.operators.extract import modality_priority

#: What waits, in the order of the log: equal times are told apart by the others, nulls first.
EVENT = "us long, priority double, stage int, src int, code string, value double, value_cat string, modality string"
FOUND = "hospitalization_id string, event_idx int, us long, code string, value double, value_cat string, modality string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _nulls_first(event: tuple) -> tuple:
    return tuple((x is not None, x) if x is not None else (False,) for x in event[:7])


def _gap(us: int, edges: list[int]) -> str | None:
    minutes = us / 60_000_000
    if minutes < 1:
        return None
    return next((f"DT//{low}-{high}" for low, high in zip(edges, edges[1:], strict=False) if minutes <= high), f"DT//{edges[-1]}+")


class StayLog(StatefulProcessor):
    """Puts out a stay's events once the watermark has passed them."""

    def __init__(self, edges: list[int]):
        self.edges = edges

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getValueState("last", "event_idx int, us long")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = [tuple(r[c] for c in ("us", "priority", "stage", "src", "code", "value", "value_cat", "modality")) for r in rows]
        if came:
            self.waiting.appendList(came)
            self._wake(min(e[0] for e in came))
        return iter(())

    def _wake(self, us: int) -> None:
        """One timer, at the earliest event that waits."""
        ms, old = -(-us // 1000), self.timer.get() if self.timer.exists() else None
        if old is not None and old[0] <= ms:
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(e) for e in self.waiting.get()]
        ready, rest = sorted((e for e in held if e[0] <= upto), key=_nulls_first), [e for e in held if e[0] > upto]
        self.timer.clear()
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(min(e[0] for e in rest))
        at, before = self.last.get() if self.last.exists() else (-1, None)
        for us, _, _, _, code, value, value_cat, modality in ready:
            gap = None if before is None else _gap(us - before, self.edges)
            if gap:
                at += 1
                yield Row(hospitalization_id=key[0], event_idx=at, us=us, code=gap, value=None, value_cat=None, modality="DT")
            at, before = at + 1, us
            yield Row(hospitalization_id=key[0], event_idx=at, us=us, code=code, value=value, value_cat=value_cat, modality=modality)
        if ready:
            self.last.update((at, before))


def stay_log(events: DataFrame, late: str = "1 hour", edges: list[int] | None = None) -> DataFrame:
    """(hospitalization_id, event_idx, time, code, value, value_cat, modality) of streamed events (hospitalization_id, time
    without zone, code, value, value_cat, modality, src, stage), in append mode.

    Events that come later than `late` behind the latest one are dropped, as the watermark has it; any others give the log
    that all events at once give, however they are cut into micro-batches. A null time is dropped. The state is kept by
    RocksDB, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.where("time is not null").withColumns({"us": micros(F.col("time")), "priority": modality_priority(F.col("modality")), "at": F.col("time").cast("timestamp")})
    rows = rows.select("hospitalization_id", "at", "us", "priority", F.col("stage").cast("int").alias("stage"), F.col("src").cast("int").alias("src"), "code", "value", "value_cat", "modality").withWatermark("at", late)
    found = rows.groupBy("hospitalization_id").transformWithState(StayLog(list(edges or C.GAP_EDGES)), FOUND, "Append", "EventTime")
    return found.select("hospitalization_id", "event_idx", from_micros(F.col("us")).alias("time"), "code", "value", "value_cat", "modality")
