import random
import time

from pyspark.sql import functions as F

from tidemark.operators import versions as V
from tidemark.session import scratch_path
from tidemark.streaming import debounce as SD
from tidemark.streaming import operators as ST
from tidemark.streaming import runner as RUN
from tidemark.streaming import state as SS

EVENT = "path string, s double, event_id long, event_type string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).select("path", F.timestamp_seconds("s").alias("ts"), "event_id", "event_type")


def dirs(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/log", f"{base}/sink", f"{base}/ckpt"


def close(spark, log, out, sink, ckpt):
    for i, s in enumerate([1e6, 2e6]):
        RUN.stage(events(spark, [("z", s, 900 + i, "change")]), log)
        RUN.to_parquet_sink(out, sink, ckpt)


def test_debounce_over_batches_with_late_events_equals_the_batch_form(spark):
    log, sink, ckpt = dirs(spark, "t-debounce")
    rnd = random.Random(2)
    rows = [(rnd.choice("pqr"), float(s), i, "change") for i, s in enumerate(rnd.sample(range(300), 60))]    # in no order
    for i in range(0, 60, 12):                                    # five micro-batches
        RUN.stage(events(spark, rows[i:i + 12]).coalesce(1), log)
        out = ST.debounce_stream(RUN.read_log(spark, log, events(spark, rows).schema), "path", "ts", 3, 300)
        RUN.to_parquet_sink(out, sink, ckpt)
    close(spark, log, out, sink, ckpt)
    got = sorted(r.event_id for r in spark.read.parquet(sink).filter("path <> 'z'").collect())
    want = sorted(r.event_id for r in V.debounce(events(spark, rows), "path", "ts", 3, tiebreak=["event_id"]).collect())
    assert got == want and len(got) > 20


def test_events_beyond_the_lateness_are_kept_apart(spark):
    base = scratch_path(spark, "t-late")
    write = ST.late_events_writer(base, "ts", 10)
    write(events(spark, [("p", 100.0, 1, "change"), ("p", 50.0, 2, "change")]), 0)
    for _ in range(2):                                            # the second time is a replay
        write(events(spark, [("p", 85.0, 3, "change"), ("p", 95.0, 4, "change"), ("p", 200.0, 5, "change")]), 1)
    write(events(spark, [("p", 120.0, 6, "change")]), 2)
    assert sorted(r.event_id for r in spark.read.parquet(f"{base}/late").collect()) == [3, 6]


def test_stop_and_resume_keeps_open_sessions(spark):
    log, sink, ckpt = dirs(spark, "t-resume")
    RUN.stage(events(spark, [("p", 0.0, 1, "change"), ("p", 2.0, 2, "change")]), log)
    schema = events(spark, []).schema
    start = lambda: RUN.run_to_end(ST.debounce_stream(RUN.read_log(spark, log, schema), "path", "ts", 3, 5)
                                   .writeStream.format("parquet").option("path", sink).outputMode("append"), ckpt, available_now=False)
    q = start()
    q.processAllAvailable()
    q.stop()                                                      # the session of p is open
    assert not q.isActive and q.exception() is None
    RUN.stage(events(spark, [("p", 4.0, 3, "change")]), log)
    q = start()
    q.processAllAvailable()
    for i, s in enumerate([1e6, 2e6]):
        RUN.stage(events(spark, [("z", s, 900 + i, "change")]), log)
        q.processAllAvailable()
    q.stop()
    assert [r.event_id for r in spark.read.parquet(sink).filter("path = 'p'").collect()] == [3]


def run_batches(spark, name, frame, state_of, parts, again=False):
    base = scratch_path(spark, name)
    state = state_of(base, frame(parts[0]).schema)
    for epoch, p in enumerate(parts):
        RUN.stage(frame(p).coalesce(1), f"{base}/log")
        if again:                                                # the split of an epoch, delivered once more
            state.writer()(frame(p), epoch)
        state.advance(RUN.read_log(spark, f"{base}/log", frame(p).schema))
    return state


def test_previous_version_over_batches(spark):
    rows = [("hot" if i % 3 else f"p{i % 7}" if i % 5 else None, i, f"text {i}") for i in range(200)]
    frame = lambda r: spark.createDataFrame(r, "path string, version long, content string")
    state = run_batches(spark, "t-prev", frame, SS.previous_version_state, [rows[i:i + 50] for i in range(0, 200, 50)])
    want = V.previous_version(frame(rows)).select("path", "version", "old_content").collect()
    key = lambda rs: sorted((str(r.path), r.version, r.old_content) for r in rs)
    assert key(SS.with_old_content(state.result(spark)).collect()) == key(want)
    assert sum(r.old_content == "" for r in want) == len({r[0] for r in rows})
    # a batch reaches the state with one row per key it holds
    for epoch in range(4):
        edges = spark.read.parquet(f"{state.path}/edges/epoch_id={epoch}")
        assert edges.count() == len({r[0] for r in rows[epoch * 50:epoch * 50 + 50]})


def test_commit_cursor_over_replayed_batches_with_null_heads(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["r", "r", "q", None]), i, i, 1, rnd.choice(["A", "A", "B", None])) for i in range(160)]
    frame = lambda r: spark.createDataFrame(r, "repo string, t long, poll_order long, poll_line int, sha string") \
        .select("repo", F.timestamp_seconds("t").cast("timestamp_ntz").alias("poll_ts"), "poll_order", "poll_line", "sha")
    state = run_batches(spark, "t-cursor", frame, SS.commit_cursor_state, [rows[i:i + 40] for i in range(0, 160, 40)], again=True)
    want = V.commit_cursor(frame(rows), ["repo"], "poll_ts", tiebreak=["poll_order", "poll_line"])
    key = lambda df: sorted((str(r.repo), r.poll_order, r.sha) for r in df.collect())
    got = SS.new_heads(state.result(spark))
    assert key(got) == key(want) and all(r.sha for r in got.collect())


def test_the_state_ignores_an_epoch_that_it_has_seen():
    from pyspark.sql import Row

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    p = SS.LastValue(["k"], "string")
    p.last = Value()
    edge = lambda k, e, v: Row(k=k, edge_epoch=e, edge_value=v)
    out = lambda *rows: [(r.k, r.carried) for r in p.handleInputRows(("key",), iter(rows), None)]
    assert out(edge("b", 1, "y"), edge("a", 0, "x")) == [("a", None), ("b", "x")]
    assert out(edge("b", 1, "y")) == []
    assert out(edge("b", 1, "y"), edge("c", 2, None)) == [("c", "y")]
    assert out(edge("d", 5, "z")) == [("d", None)]


def test_source_events(spark):
    e = events(spark, [("a.cs", 1.0, 1, "change"), ("b.CS", 1.0, 2, "rename"), ("c.cs", 1.0, 3, "delete"), ("d.txt", 1.0, 4, "change")])
    assert sorted(r.event_id for r in ST.source_events(e, ".cs").collect()) == [1, 2]


def test_debounce_in_any_order_equals_the_batch_form(spark):
    """Events come in no order, some twice, over several runs; what stands at
    the end, and after each run, is what the batch form gives."""
    base = scratch_path(spark, "t-debounce-late")
    rnd = random.Random(8)
    rows = [(rnd.choice(["p", "p", "q", None]), float(rnd.choice([s, s + 0.25, s - 1000])), i, "change") for i, s in enumerate(rnd.choices(range(200), k=80))]
    rows += [("r", 10.0, 200, "change"), ("r", 10.0, 201, "rename"), ("r", 13.0, 202, "change"), ("r", 16.000001, 203, "change"), ("r", None, 204, "change")]
    rnd.shuffle(rows)
    schema = events(spark, []).schema
    state = SD.Debounce(base, schema, "path", "ts", 3)
    order = lambda df: sorted(map(tuple, df.select("path", "ts", "event_id", "event_type", "fire_ts").collect()), key=str)
    for k in range(0, len(rows), 30):
        RUN.stage(events(spark, rows[max(0, k - 3):k + 30]).coalesce(1), f"{base}/log")        # three rows again
        state.advance(RUN.read_log(spark, f"{base}/log", schema))
        seen = events(spark, [r for r in rows[:k + 30] if r[1] is not None])
        assert order(state.fired(spark)) == order(V.debounce(seen, "path", "ts", 3, tiebreak=["event_id"]))
    taken_back = state.log(spark).where("not fired")
    assert taken_back.count() > 3 and state.log(spark).groupBy("path", "event_id", "fired").count().where("count > 1").count() == 0


def test_debounce_waits_for_its_time(spark):
    """An event of now fires by its timer, in a run that has no event of its
    key, and not before."""
    base = scratch_path(spark, "t-debounce-timer")
    now = time.time()
    schema = events(spark, []).schema
    state = SD.Debounce(base, schema, "path", "ts", 12)
    fired = lambda: sorted(r.event_id for r in state.fired(spark).collect())

    def turn(rows):
        RUN.stage(events(spark, rows).coalesce(1), f"{base}/log")
        state.advance(RUN.read_log(spark, f"{base}/log", schema))

    turn([("old", now - 1000, 1, "change")])
    assert fired() == [1]                         # the past: at once, or in the run that moves the clock
    turn([("p", now + 60, 2, "change"), ("q", time.time(), 3, "change")])
    assert 2 not in fired()
    time.sleep(18)
    turn([("old", now - 500, 4, "change")])
    assert fired() == [1, 3, 4]


def test_ticks_of_a_span_are_read_and_written_once():
    """A key's batch of many ticks is a few calls to the state store."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    class Spans:
        held, calls = {}, 0

        def getValue(self, key):
            self.calls += 1
            return self.held.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self.held[key] = value

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10**9

    p = SD.Ticks("path", 10, T.StructType().add("event_id", "long").add("event_type", "string"))
    p.spans = Spans()
    tick = lambda t, first, last, e: Row(tick=t, first_us=first, last_us=last, event_id=e, event_type=None)
    run = lambda *rows: [(r.event_id, r.fired) for r in p.handleInputRows(("a",), iter(rows), Now())]
    got = run(*(tick(t, 10 * t, 10 * t, t) for t in range(0, 400, 2)))          # 20 apart: all fire
    assert got == [(t, True) for t in range(0, 400, 2)]
    assert p.spans.calls <= 4                                                   # the span, and the one before
    assert run(tick(1, 15, 15, 1000)) == []                                     # followed by 20, within the gap
    assert run(tick(1, 10, 15, 1001)) == [(0, False)]                           # 0 is followed by 10
    assert p.spans.calls <= 12
