"""Activities of runs as a stream: starts paired with finishes, and what was left open when its run ended.

What becomes of an activity is the earliest of three: its finish (complete), the end of its run (interrupted), and too long
a silence (stalled). It is told once the watermark has passed that moment, when nothing earlier can come any more, so the
result does not depend on the order or the pace in which rows arrive: a finish may come before its start, or both after
the run's end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["run", "activity", "started", "finished", "status"]
START, FINISH, END = "start", "finish", "end"


def use_rocks(spark: SparkSession) -> str | None:
    """Sets the state store that such streams need; returns what was set before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    return before


def milliseconds(micros: int) -> int:
    return -(-micros // 1000)


#: A run's state, in microseconds: open starts, finishes whose start is to come, and ends.
STATE = "starts array<bigint>, started array<bigint>, finishes array<bigint>, finished array<bigint>, ends array<bigint>"


class Pairing(StatefulProcessor):
    """What is open in a run is one value with one timer, at the first moment at which something of it is settled or over.

    So a batch reads and writes a run's state once, however many activities it has; of two starts or finishes the first counts.
    """

    def __init__(self, silence_minutes: int):
        self.silence = silence_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def load(self) -> tuple[dict, dict, set]:
        if not self.held.exists():
            return {}, {}, set()
        starts, started, finishes, finished, ends = self.held.get()
        return dict(zip(starts, started)), dict(zip(finishes, finished)), set(ends)

    def store(self, starts: dict, finishes: dict, ends: set, due: int | None) -> None:
        if due is None:
            return self.held.clear()
        self.held.update((list(starts), list(starts.values()), list(finishes), list(finishes.values()), list(ends)))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, Spark's names
        starts, finishes, ends = self.load()
        for frame in rows:
            for activity, kind, at in frame[["activity", "kind", "micros"]].itertuples(index=False):
                if kind == END:
                    ends.add(int(at))
                else:
                    table, activity = starts if kind == START else finishes, int(activity)
                    table[activity] = min(int(at), table.get(activity, int(at)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.store(starts, finishes, ends, self.due(starts, finishes, ends))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame(self.settled(key[0], timerValues.getCurrentWatermarkInMs()), columns=COLUMNS)

    def closed(self, starts: dict, finishes: dict, ends: set) -> Iterator[tuple[int, int, int, str]]:
        """(activity, started, when, status) of each open start, as far as is known by now."""
        ordered = sorted(ends)
        for activity, at in starts.items():
            ways = [(finishes[activity], 0, "complete")] if finishes.get(activity, -1) >= at else []
            place = bisect_left(ordered, at)
            ways += [(e, 1, "interrupted") for e in ordered[place : place + 1]] + [(at + self.silence, 2, "stalled")]
            when, _, status = min(ways)
            yield activity, at, when, status

    def due(self, starts: dict, finishes: dict, ends: set) -> int | None:
        """The first moment, in milliseconds, at which anything held is settled or over; null if nothing is held."""
        moments = [w[2] for w in self.closed(starts, finishes, ends)] + [at for a, at in finishes.items() if a not in starts]
        # An end is over once no open start is at or before it, and those settle at it at the latest.
        moments += ends
        return milliseconds(min(moments)) if moments else None

    def settled(self, run, watermark: int) -> list[tuple]:
        """What can be told of the run's activities by now; the rest is held on."""
        starts, finishes, ends = self.load()
        out = [(run, activity, at, when, status) for activity, at, when, status in self.closed(starts, finishes, ends) if milliseconds(when) <= watermark]
        told = {o[1] for o in out}
        starts = {a: at for a, at in starts.items() if a not in told}
        finishes = {a: at for a, at in finishes.items() if a in starts or milliseconds(at) > watermark}
        first = min(starts.values(), default=None)
        ends = {e for e in ends if milliseconds(e) > watermark or (first is not None and first <= e)}
        self.store(starts, finishes, ends, self.due(starts, finishes, ends))
        return sorted(out)

    def close(self) -> None:
        pass


def activity_pairs(rows: DataFrame, run: str = "run", silence_minutes: int = 65, late: str = "2 hours") -> DataFrame:
    """run, activity, started, finished (microseconds) and status of each activity of a stream of (run, activity, kind, at).

    Kinds are start, finish and end; an end closes all that its run has open. Needs the session's RocksDB state store (use_rocks()).
    """
    from pyspark.sql import functions as F

    marked = rows.select(F.col(run).cast("long").alias("run"), F.col("activity").cast("long").alias("activity"), "kind", "at", F.unix_micros("at").alias("micros")).withWatermark("at", late)
    return marked.groupBy("run").transformWithStateInPandas(Pairing(silence_minutes), "run long, activity long, started long, finished long, status string", "append", "eventTime")
