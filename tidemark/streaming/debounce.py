"""Debounce of a stream in any order (T1): timers and corrections.

An event fires when no event of its key follows within the gap.  A
``foreachBatch`` function folds a micro-batch into *ticks* as wide as the gap:
per key and tick the first time and the last event, a partial aggregate, so a
hot key is a few rows.  Events of one tick are one burst, and whether a tick's
last event fires depends on the first event of the next tick alone; so the
state of a key is a map of ticks, kept in spans of ``SPAN`` ticks, of which a
batch reads and writes those it touches once each: a call to the state store
costs far more than the ticks of a span.

A tick's last event is due when the clock passes it by the gap: at once for
events of the past, else by a timer.  The clock is the time at which batches
came in, not the time in the events, so the watermark drops nothing however
late an event is.  A late event that follows a fired one within the gap takes
it back: the result is a log of firings and withdrawals, and ``fired`` gives
the events that stand.  Once all input is in, these are what the batch form
gives.  The state keeps every tick and never expires.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.streaming.runner import run_to_end, to_parquet_sink
from tidemark.streaming.state import publish, state_store

#: How far the driver's clock may be set back between two batches.
CLOCK_SLACK_SECONDS = 5

#: Ticks of one value of the state.
SPAN = 512


class Ticks(StatefulProcessor):
    """Ticks of a key -> firings and withdrawals of its events.  ``event``:
    the columns of an event besides key and time, the tiebreak first.  The
    state is flat and holds times as numbers."""

    def __init__(self, key: str, gap_us: int, event: T.StructType):
        self.key, self.gap, self.event = key, gap_us, event

    def init(self, handle) -> None:
        self.handle = handle
        event = ", ".join(f"`e_{f.name}` array<{f.dataType.simpleString()}>" for f in self.event)
        self.spans = handle.getMapState("spans", "span long", f"tick array<long>, first_us array<long>, announced array<boolean>, last_us array<long>, {event}")

    def _span(self, tick: int) -> dict:
        """Tick -> (first time, last event as (time, tiebreak, ...), announced)."""
        span = tick // SPAN
        if span not in self.known:
            found = self.spans.getValue((span,))                  # None where there is none
            self.known[span] = {t: (first, tuple(last), announced) for t, first, announced, *last in zip(*found, strict=True)} if found else {}
        return self.known[span]

    def _get(self, tick: int):
        return self._span(tick).get(tick)

    def _put(self, tick: int, first: int, last: tuple, announced: bool) -> None:
        self._span(tick)[tick] = (first, last, announced)
        self.changed.add(tick // SPAN)

    def _begin(self) -> None:
        """Spans of one key and call, read once and written once at the end."""
        self.known, self.changed = {}, set()

    def _end(self) -> None:
        for span in self.changed:
            rows = [(t, first, announced, *last) for t, (first, last, announced) in sorted(self.known[span].items())]
            self.spans.updateValue((span,), tuple(map(list, zip(*rows, strict=True))))

    def _row(self, key, last: tuple, fired: bool) -> Row:
        return Row(**{self.key: key[0]}, last_us=last[0], **dict(zip(self.event.names, last[1:])), fired=fired)

    def _rule(self, tick: int, now_us: int, key) -> Iterator[Row]:
        """Fire, wait for or withdraw the tick's last event."""
        mine = self._get(tick)
        if mine is None:
            return
        first, last, announced = mine
        after = self._get(tick + 1)
        due = last[0] + self.gap
        stands = after is None or after[0] > due
        if stands and not announced:
            if due <= now_us:
                self._put(tick, first, last, True)
                yield self._row(key, last, True)
            else:
                self.handle.registerTimer(-(-due // 1000))
        elif announced and not stands:
            self._put(tick, first, last, False)
            yield self._row(key, last, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._begin()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        touched = set()
        for r in rows:
            tick, first, announced = r["tick"], r["first_us"], False
            last = (r["last_us"], *(r[c] for c in self.event.names))
            known = self._get(tick)
            if known is not None:
                first = min(first, known[0])
                if known[1][:2] >= last[:2]:                  # time and tiebreak
                    _, last, announced = known
                elif known[2]:
                    yield self._row(key, known[1], False)
            self._put(tick, first, last, announced)
            touched |= {tick, tick - 1}
        for tick in sorted(touched):
            yield from self._rule(tick, now, key)
        self._end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._begin()
        due_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        last = (due_us - self.gap) // self.gap
        for tick in (last - 1, last):             # a timer is up to a millisecond after its event is due
            yield from self._rule(tick, due_us, key)
        self._end()

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Debounce:
    """Debounce of events with the columns ``schema``; ``path`` holds its log
    and checkpoints.  Events without a time or a tiebreak are no events."""

    path: str
    schema: T.StructType
    key: str
    ts: str
    gap_seconds: float
    tiebreak: str = "event_id"
    payload: Sequence[str] = ("event_type",)

    @property
    def _gap_us(self) -> int:
        return round(self.gap_seconds * 1_000_000)

    def _event(self) -> T.StructType:
        return T.StructType([self.schema[f] for f in (self.tiebreak, *self.payload)])

    def ticks(self, events: DataFrame) -> DataFrame:
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        e = events.where(F.col(self.ts).isNotNull() & F.col(self.tiebreak).isNotNull())
        # of a multiple, so the quotient is exact
        tick = ((us - F.pmod(us, F.lit(self._gap_us))) / F.lit(self._gap_us)).cast("long")
        e = e.select(self.key, tick.alias("tick"), us.alias("us"), F.struct(us.alias("last_us"), *self._event().names).alias("last"))
        order = F.struct("us", F.col("last")[self.tiebreak])
        t = e.groupBy(self.key, "tick").agg(F.min("us").alias("first_us"), F.max_by("last", order).alias("last"))
        return t.select(self.key, "tick", "first_us", "last.*", F.current_timestamp().alias("arrived"))

    def changes(self, spark: SparkSession) -> DataFrame:
        """The stream of firings and withdrawals."""
        us = T.StructField("last_us", T.LongType())
        log = T.StructType([self.schema[self.key], T.StructField("tick", T.LongType()), T.StructField("first_us", T.LongType()), us, *self._event(),
                            T.StructField("arrived", T.TimestampType())])
        out = T.StructType([self.schema[self.key], us, *self._event(), T.StructField("fired", T.BooleanType())])
        s = spark.readStream.schema(log).parquet(f"{self.path}/ticks").withWatermark("arrived", f"{CLOCK_SLACK_SECONDS} seconds")
        return s.groupBy(self.key).transformWithState(Ticks(self.key, self._gap_us, self._event()), out, "Append", "EventTime")

    def advance(self, stream: DataFrame) -> None:
        """Take up what has come in: ticks, then timers and state."""
        spark = stream.sparkSession

        def write(batch: DataFrame, epoch_id: int) -> None:
            publish(batch.sparkSession, lambda: self.ticks(batch), f"{self.path}/ticks", epoch_id)

        run_to_end(stream.writeStream.foreachBatch(write), f"{self.path}/checkpoint-ticks")
        with state_store(spark):
            to_parquet_sink(self.changes(spark), f"{self.path}/changes", f"{self.path}/checkpoint-changes")

    def log(self, spark: SparkSession) -> DataFrame:
        """All firings and withdrawals so far."""
        c = spark.read.parquet(f"{self.path}/changes")
        ts = F.timestamp_micros("last_us").cast(self.schema[self.ts].dataType)
        return c.select(self.key, ts.alias(self.ts), *self._event().names, "fired")

    def fired(self, spark: SparkSession) -> DataFrame:
        """Events that stand, with ``fire_ts``.  An event fires once and is
        withdrawn at most once, as events are only added."""
        gap = F.make_dt_interval(secs=F.lit(self.gap_seconds))
        c = self.log(spark).groupBy(self.key, self.ts, *self._event().names).agg(F.sum(F.when(F.col("fired"), 1).otherwise(-1)).alias("n"))
        return c.where("n > 0").drop("n").withColumn("fire_ts", F.col(self.ts) + gap)
