"""Render requests as one machine: debounce, latest wins, cancel, one in flight, gate, preview and full.

What happens to a session's events (``ts, key, kind, generation, payload``; ordered by ts and
generation):

* ``begin`` closes the gate and ends what is pending or running. ``end`` opens it.
* ``load`` ends what is pending or running and asks for a render; behind the gate that waits
  for the ``end``.
* ``cancel`` ends what is pending or running.
* Any other kind sets the session's value and asks for a render, which ends what is pending or
  running; behind the gate it sets the value only.

A render starts ``gap`` after it was asked for, if nothing ended it, with the value that was set
last. It shows its preview ``preview`` later and its full frame ``full`` after that, each only
if nothing ended it before. At the same time frames come before events. So at most one render
of a session is pending or running. All durations are in milliseconds; a null kind counts as
any other kind, a null generation as 0, a payload of NaN as null; rows with a null time are left out.

:func:`schedule` says this of a table with windows, :func:`scheduled` of a stream with a state
machine; they return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAMES_DDL = "key long, generation long, payload double, pass string, shown_ms long"
_EVENT_DDL = "at long, kind string, generation long, payload double"
#: The state store that keeps lists, values and timers of a session.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _requests(rows: DataFrame, *more: str) -> DataFrame:
    payload = F.when(~F.isnan("payload"), F.col("payload")).alias("payload")
    kind, generation = F.coalesce("kind", F.lit("change")).alias("kind"), F.coalesce("generation", F.lit(0)).alias("generation")
    return rows.filter(F.col("ts").isNotNull()).select(*more, "key", _ms(F.col("ts")).alias("at"), kind, generation, payload)


def schedule(requests: DataFrame, *, gap: int, preview: int, full: int) -> DataFrame:
    """key, generation, payload, pass, shown_ms: the frames that the sessions of a table show.

    Three windows over a session in order of time: whether the gate is closed, what was set
    last, and when the next event ends what this one asked for.
    """
    rows = _requests(requests)
    order = W.partitionBy("key").orderBy("at", "generation")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("key").orderBy(F.desc("at"), F.desc("generation")).rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("kind")
    gate = F.last(F.when(kind.isin("begin", "end"), kind), ignorenulls=True).over(upto)
    told = rows.withColumn("closed", F.coalesce(gate == "begin", F.lit(False)))
    ends = F.sum(F.when(kind == "end", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    told = told.withColumn("operation", F.coalesce(ends, F.lit(0)))
    loads = F.sum(F.when((kind == "load") & F.col("closed"), 1).otherwise(0)).over(W.partitionBy("key", "operation"))
    sets = ~kind.isin("begin", "end", "cancel")
    set_last = F.last(F.when(sets, F.struct("generation", "payload")), ignorenulls=True).over(upto)
    told = told.withColumn("owed", loads > 0).withColumn("value", set_last)
    asks = F.when(kind == "end", F.col("owed")).otherwise(sets & ~F.col("closed"))
    stops = F.when(kind == "end", F.col("owed")).when(kind.isin("begin", "cancel", "load"), F.lit(True)).otherwise(~F.col("closed"))
    asked = told.withColumn("asks", asks).withColumn("until", F.last(F.when(stops, F.col("at")), ignorenulls=True).over(back)).filter("asks")
    frames = F.explode(F.array(*(F.struct(F.lit(name).alias("pass"), (F.col("at") + wait).alias("shown_ms")) for name, wait in (("preview", gap + preview), ("full", gap + preview + full)))))
    shown = asked.select("key", F.col("value.generation").alias("generation"), F.col("value.payload").alias("payload"), "until", frames.alias("f"))
    return shown.filter(F.col("until").isNull() | (F.col("f.shown_ms") <= F.col("until"))).select("key", "generation", "payload", "f.pass", "f.shown_ms")


class Session:
    """A session's part of the machine: fed events in order and the time, it yields frames."""

    def __init__(self, gap: int, preview: int, full: int):
        self.waits = (gap + preview, full)
        self.closed = self.owed = False
        self.generation, self.payload = 0, None  # what was set last
        self.due, self.stage = None, 0  # the next frame's time, and which it is
        self.shows = (0, None)  # what the pending or running render shows

    def until(self, now: int) -> Iterator[tuple]:
        """Frames due up to ``now``: generation, payload, pass, time."""
        while self.due is not None and self.due <= now:
            yield (*self.shows, ("preview", "full")[self.stage], self.due)
            self.due, self.stage = (self.due + self.waits[1], 1) if not self.stage else (None, 0)

    def _stop(self) -> None:
        self.due, self.stage = None, 0

    def _ask(self, at: int) -> None:
        self.due, self.stage, self.shows = at + self.waits[0], 0, (self.generation, self.payload)

    def feed(self, at: int, kind: str, generation: int, payload: float | None) -> Iterator[tuple]:
        yield from self.until(at)
        if kind == "begin":
            self.closed = True
            self._stop()
        elif kind == "end":
            self.closed = False
            if self.owed:
                self.owed = False
                self._ask(at)
        elif kind == "cancel":
            self._stop()
        else:
            self.generation, self.payload = generation, payload
            if kind == "load":
                self._stop()
                self.owed = self.owed or self.closed
            if not self.closed:
                self._ask(at)

    def state(self) -> tuple:
        generation, payload = self.shows if self.due is not None else (0, None)
        return self.closed, self.owed, self.generation, self.payload, self.due, self.stage, generation, payload

    def restore(self, state: tuple) -> Session:
        self.closed, self.owed, self.generation, self.payload, self.due, self.stage, *shows = state
        self.shows = tuple(shows)
        return self


_STATE_DDL = "closed boolean, owed boolean, generation long, payload double, due long, stage int, shown_generation long, shown_payload double"


def _plain(value: object) -> object:
    """A state's field as Python has it; numbers that Arrow could not tell from null come back so."""
    return None if value is None or value != value else value


class _Scheduler(StatefulProcessor):
    """Events wait in a list until the watermark has passed them, and are then replayed in order.

    So the frames do not depend on how the stream is cut into batches. A timer stands at the
    earliest time at which something is due: an event's own time or a frame's.
    """

    def __init__(self, gap: int, preview: int, full: int):
        self.durations = (gap, preview, full)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT_DDL)
        self.session = handle.getValueState("session", _STATE_DDL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(at), kind, int(g), None if p != p else float(p)) for part in rows for at, kind, g, p in zip(part["at"], part["kind"], part["generation"], part["payload"], strict=True)]
        self.waiting.appendList(came)
        self._wake([at for at, *_ in came], timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        session = Session(*self.durations)
        if self.session.exists():
            session.restore(tuple(map(_plain, self.session.get())))
        events = [tuple(map(_plain, e)) for e in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((e for e in events if e[0] <= now), key=lambda e: (e[0], e[2]))
        later = [e for e in events if e[0] > now]
        frames = [f for e in ripe for f in session.feed(*e)]
        frames += session.until(min([now, *(e[0] for e in later)]))
        self.session.update(session.state())
        if later:
            self.waiting.put(later)
        elif events:
            self.waiting.clear()
        self._wake([e[0] for e in later] + ([session.due] if session.due is not None else []), now, expiredTimerInfo.getExpiryTimeInMs())
        if frames:
            yield pd.DataFrame([(key[0], *f) for f in frames], columns=["key", "generation", "payload", "pass", "shown_ms"])

    def _wake(self, times: list[int], now: int, fired: int | None = None) -> None:
        """One timer at the earliest of ``times`` and of the timer that stands, but for the one that fired."""
        wanted = min(times, default=None)
        if wanted is None:
            return
        wanted = max(wanted, now + 1)
        standing = [t for t in self.handle.listTimers() if t != fired]
        if any(t <= wanted for t in standing):
            return
        for t in standing:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


def scheduled(stream: DataFrame, *, gap: int, preview: int, full: int) -> DataFrame:
    """The frames of :func:`schedule` from a stream with a watermark on ``ts``, in append mode.

    The session needs :data:`ROCKSDB` as its state store. Events later than the watermark
    allows are dropped, as Spark does; all else comes out the same however the stream is cut.
    """
    rows = _requests(stream, "ts")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Scheduler(gap, preview, full), outputStructType=FRAMES_DDL, outputMode="Append", timeMode="EventTime")


class _Latest(StatefulProcessor):
    """The last value of each kind of a session in a map, which forgets what is not set for a time."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "kind string", "generation long, payload double", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for part in rows:
            for kind, g, p in zip(part["kind"], part["generation"], part["payload"], strict=True):
                if kind not in newest or newest[kind][0] < g:
                    newest[kind] = (int(g), None if p != p else float(p))
        changed = []
        for kind, value in newest.items():
            if not self.values.containsKey((kind,)) or self.values.getValue((kind,))[0] < value[0]:
                self.values.updateValue((kind,), value)
                changed.append((key[0], kind, *value))
        if changed:
            yield pd.DataFrame(changed, columns=["key", "kind", "generation", "payload"])

    def close(self) -> None:
        pass


def latest_stream(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """key, kind, generation, payload: each new last value of a key and kind, in update mode.

    The last row of a key and kind is that of ``requests.latest_values`` for every cut of the
    stream. ``keep_ms`` of processing time after its last change a value is forgotten.
    """
    rows = stream.select("key", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("generation", F.lit(0)).alias("generation"), "payload")
    processor = _Latest(keep_ms)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType="key long, kind string, generation long, payload double", outputMode="Update", timeMode="ProcessingTime" if keep_ms else "None")


def drained(source: DataFrame, run: Callable[[DataFrame], DataFrame], ddl: str, folder: str) -> DataFrame:
    """What the stream operator ``run`` puts out for all rows of a table with ``ts`` and ``key``, as a table.

    The rows are written under ``folder``, a shared one, and read as a stream. A last event,
    far later and of no session, then moves the watermark past everything; the second run goes
    on from the checkpoint of the first, as it would after a loss.
    """
    spark, setting = source.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        source.write.parquet(f"{folder}/in/0")
        last = source.agg(F.max("ts").alias("ts")).filter("ts is not null").select(*(F.expr("ts + interval 1000 days").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema))
        for step in range(2):
            if step:
                last.coalesce(1).write.parquet(f"{folder}/in/1")
            stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in/*").withWatermark("ts", "1 second")
            sink = run(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            sink.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(ddl).parquet(f"{folder}/out").filter(F.col("key").isNotNull())
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
