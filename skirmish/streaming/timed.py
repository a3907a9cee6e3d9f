"""State machines with event-time timers on Structured Streaming.

A machine keeps plain values for a key.  Rows come to it in order, and it says when
something is due without another row; a registered timer calls it when the watermark
has passed that moment.  A machine that reads several logs waits for the watermark
before it takes rows, so that they come in the order of their stamps however they were
cut into batches; one that reads a single log takes them as its lines come.

The watermark follows the newest stamp of all logs, `late` behind; rows of a log that
lags more than that are dropped by Spark.  When all logs are quiet nothing moves it: a
stream of ticks (clock, with a column ts) does, and stands for the wall clock.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: How far a log may lag the newest one.
LATE = "1 minute"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """What a key's rows and the passing of time do.  held: plain values, empty at the
    start and after the machine has cleared them."""

    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    waits = False

    def rows(self, key: tuple, held: dict, rows: list) -> list[tuple]:
        """Rows (columns) in order -> rows out."""
        raise NotImplementedError

    def time(self, key: tuple, held: dict, until: float) -> list[tuple]:
        """No row with a stamp up to `until` (seconds) comes any more -> rows out."""
        raise NotImplementedError

    def due(self, held: dict) -> float | None:
        """When `time` has something to do next."""
        raise NotImplementedError


class Replay(StatefulProcessor):
    """Runs a machine for each key."""

    def __init__(self, machine: Machine, names: list[str]):
        self.machine, self.names = machine, names

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string")
        if self.machine.waits:
            self.waiting = handle.getListState("waiting", "ts double, row string")

    def handleInputRows(self, key, rows, timerValues):
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(list(self.machine.order), kind="stable")
        told = json.loads(pdf[list(self.machine.columns)].to_json(orient="values"))
        if self.machine.waits:
            at = self.machine.columns.index("ts")
            self.waiting.appendList([(float(r[at]), json.dumps(r)) for r in told])
            self._register(min(r[at] for r in told))
            return
        held = self._read()
        out = self.machine.rows(key, held, told)
        self._write(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() / 1000
        held, out = self._read(), []
        if self.machine.waits and self.waiting.exists():
            every = list(self.waiting.get())
            ready = sorted((json.loads(row) for ts, row in every if ts <= until), key=lambda r: [r[self.machine.columns.index(c)] for c in self.machine.order])
            later = [(ts, row) for ts, row in every if ts > until]
            if ready:
                out += self.machine.rows(key, held, ready)
                if later:
                    self.waiting.put(later)
                    self._register(min(ts for ts, _ in later))
                else:
                    self.waiting.clear()
        out += self.machine.time(key, held, until)
        self._write(held)
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        return json.loads(self.held.get()[0]) if self.held.exists() else {}

    def _write(self, held: dict) -> None:
        if not held:
            self.held.clear()
            return
        self.held.update((json.dumps(held),))
        due = self.machine.due(held)
        if due is not None:
            self._register(due)

    def _register(self, at: float) -> None:
        self.handle.registerTimer(int(-(-at * 1000 // 1)))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.names, dtype=object)


def use_timers(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; chosen unless the session names another
    than Spark's default."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def timed(rows: DataFrame, keys: tuple[str, ...], machine: Machine, schema: str, late: str = LATE, clock: DataFrame | None = None) -> DataFrame:
    """rows (with ts, in seconds, and seq) through the machine of their key."""
    use_timers(rows.sparkSession)
    rows = rows.withColumn("_at", F.timestamp_millis((F.col("ts") * 1000).cast("long")))
    if clock is not None:
        rows = rows.unionByName(clock.select(F.timestamp_millis((F.col("ts") * 1000).cast("long")).alias("_at")), allowMissingColumns=True)
    # Ticks move the watermark and go no further; naming _at keeps the filter behind it.
    marked = rows.withWatermark("_at", late).where("seq is not null or _at is null")
    names = [c.strip().split()[0] for c in schema.split(",")]
    return marked.groupBy(*keys).transformWithStateInPandas(Replay(machine, names), schema, "append", "eventTime")
