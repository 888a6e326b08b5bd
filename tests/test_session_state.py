"""Chunked samples, their ranges and what a trigger writes; timers; the upsert sink; times past the end."""

import numpy as np
import pytest

from wavemill.config import MS, GateConfig
from wavemill.streaming import session as ss
from wavemill.streaming.buffer import Buffer, RangeError
from wavemill.streaming.sink import UpsertSink

SMALL = GateConfig(min_speech=4 * MS, min_silence=8 * MS, pad=2 * MS, frame=64)
COMMANDS = "session_id string, cmd_seq long, cmd string, source_id long, ts_ns long, samples array<float>, at timestamp"


class Store:
    """Counts what is written, as the map state would hold it."""

    def __init__(self):
        self.rows, self.written, self.reads = {}, [], 0

    def get(self, start):
        self.reads += 1
        return self.rows[start]

    def put(self, start, samples):
        self.rows[start] = samples
        self.written.append(samples.nbytes)

    def remove(self, start):
        del self.rows[start]


def test_ranges():
    b = Buffer(store=Store())
    b.append(0, np.zeros(1000))
    b.trim(900)
    b.append(1000, np.ones(100))
    assert (len(b), b.base) == (200, 900)
    for lo, hi in ((899, 1000), (950, 1101), (1000, 1000), (1000, 950)):
        with pytest.raises(RangeError):
            b.take(lo, hi)
    assert list(b.take(950, 1050)) == [0] * 50 + [1] * 50 and b.base == 1050
    b.take(1050, 1100)
    b.append(5000, np.ones(3))  # an empty buffer takes its place from the samples
    b.append(1, np.ones(2))
    assert (b.base, b.end, list(b.take(5001, 5005))) == (5000, 5005, [1] * 4)


def test_chunks_over_commits():
    """Against one array, with commits and reloads at random."""
    rng = np.random.default_rng(6)
    store, whole, at, base = Store(), np.zeros(0, np.float32), 0, 0
    b = Buffer(store=store)
    for _ in range(300):
        x = rng.normal(size=int(rng.integers(0, 40))).astype(np.float32)
        b.append(b.end, x)
        whole, at = np.concatenate((whole, x)), at + len(x)
        if rng.random() < 0.3 and at - base > 2:
            lo = int(rng.integers(base, at - 1))
            hi = int(rng.integers(lo + 1, at))
            assert np.array_equal(b.take(lo, hi), whole[lo:hi])
            base = hi
        elif rng.random() < 0.3:
            base = max(base, min(at, base + int(rng.integers(0, 60))))
            b.trim(base)
        if rng.random() < 0.4:
            b.commit()
            assert sum(len(c) for c in store.rows.values()) == b.end - b.first
            b = Buffer(b.base, b.end, b.first, store)
    assert len(store.rows) < 30


def test_writes_follow_new_audio():
    """30 s of open speech: each trigger writes its own chunk, and nothing in silence."""
    gate, s, store = ss.Gate(GateConfig(), ss.energy_score), ss.Source(), Store()
    s.buffer.store = store
    for i in range(290):
        before = sum(store.written)
        assert list(gate.push(s, np.full(1600, 0.5, np.float32))) == []
        s.buffer.commit()
        assert sum(store.written) - before == 6400
        s.buffer = Buffer(s.buffer.base, s.buffer.end, s.buffer.first, store)
    assert store.reads <= 290 and len(s.tail) < 512
    (lo, hi, pcm), *more = list(gate.finish(s))
    assert (lo, hi, len(pcm), more) == (0, 464_000, 464_000, [])
    s.buffer.commit()
    assert store.rows == {}
    quiet, before = np.zeros(1600, np.float32), sum(store.written)
    for i in range(50):
        list(gate.push(s, quiet))
        s.buffer.commit()
        s.buffer = Buffer(s.buffer.base, s.buffer.end, s.buffer.first, store)
        assert len(store.rows) <= 1
    assert sum(store.written) - before <= 50 * 6400


def test_times_past_the_end():
    """A segment past the last nanosecond ends the session, after what came before; its id is used up."""
    last = (1 << 63) - 1
    handler, state, out = ss.Handler(ss.Gate(SMALL, ss.energy_score), ss.FakeModel(), 2), ss.new_session(), []
    loud, quiet = np.ones(640, np.float32), np.zeros(640, np.float32)
    for c in [(0, "audio", 0, last - 50 * MS, loud), (1, "audio", 0, None, quiet), (2, "audio", 0, None, loud), (3, "close", 0, None, None), (4, "open", None, None, None)]:
        out.extend(handler.handle(state, *c))
    assert [(r[1], r[2], r[7]) for r in out] == [("segment", 0, None), ("error", None, "invalid_timestamp")] and state.over and state.next_id == 2


def test_range_error_is_terminal():
    class Short(ss.Gate):
        def _take(self, s, start, end):
            return start, end, s.buffer.take(start, s.buffer.end + 1)

    handler, state = ss.Handler(Short(SMALL, ss.energy_score), ss.FakeModel(), 2), ss.new_session()
    out = [r for c in [(0, "audio", 0, None, np.ones(640)), (1, "close", 0, None, None), (2, "audio", 0, None, np.ones(640))] for r in handler.handle(state, *c)]
    assert [(r[1], r[7]) for r in out] == [("error", "vad")]


def test_vanished_senders_in_a_table(spark):
    rows = [("a", 0, "open", None, None, None, None), ("a", 1, "audio", 1, None, [1.0] * 640, None), ("a", 2, "audio", 0, None, [1.0] * 640, None), ("b", 0, "cancel", None, None, None, None), ("c", 0, "close", 0, None, None, None)]
    df = spark.createDataFrame(rows, COMMANDS)
    got = sorted(ss.transcribe_table(df, SMALL, vanish=True).collect(), key=lambda r: (r.session_id, r.kind, r.id or 0))
    assert [(r.session_id, r.kind, r.id, r.source_id, r.cmd_seq) for r in got] == [
        ("a", "end_of_stream", None, None, None), ("a", "reply", None, 1, 0), ("a", "segment", 0, 0, None), ("a", "segment", 1, 1, None), ("c", "end_of_stream", None, None, 0), ("c", "reply", None, 0, 0)]
    assert not ss.transcribe_table(df, SMALL).where("kind = 'segment'").collect()
    assert ss.transcribe_table(df.where("false"), SMALL, vanish=True).collect() == []


def streamed(spark, tmp_path, batches, **options):
    """Rows of each batch as a file of their own, in order, through the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
    return ss.transcribe_stream(stream, SMALL, idle_ms=60_000, event_time=True)


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_timer_flushes_once(spark, tmp_path):
    """A session that stays silent is flushed in opening order and ended; one that goes on, or ended, is left alone."""
    loud = [1.0] * 640
    first = [("gone", 0, "open", None, None, None, at(1)), ("gone", 1, "audio", 1, None, loud, at(1)), ("gone", 2, "audio", 0, None, loud, at(2)), ("kept", 0, "audio", 0, None, loud, at(2)), ("done", 0, "close", 0, None, None, at(2))]
    second = [("kept", 1, "audio", 0, None, loud, at(50))]
    third = [("kept", 2, "audio", 0, None, loud, at(100)), ("other", 0, "audio", 0, None, loud, at(100))]
    fourth, fifth = [("other", 1, "audio", 0, None, loud, at(102))], [("gone", 3, "audio", 0, None, loud, at(103))]
    said = streamed(spark, tmp_path, [first, second, third, fourth, fifth])
    q = said.writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.table("flushed").where("kind <> 'reply'").select("session_id", "kind", "id", "source_id", "cmd_seq", "start_ns").collect()), key=str)
    assert got == sorted([("gone", "segment", 0, 0, None, 0), ("gone", "segment", 1, 1, None, 0), ("gone", "end_of_stream", None, None, None, None), ("done", "end_of_stream", None, None, 0, None)], key=str)


EVENTS = "session_id string, cmd_seq long, kind string, id long, source_id long, text string, start_ns long, end_ns long, code string"


def rows_of(sink, spark):
    return sorted((r.session_id, r.kind, r.id, r.text) for r in sink.events(spark).collect())


def test_sink_merges_and_replays(spark, tmp_path):
    make = lambda rows: spark.createDataFrame([(s, q, k, i, None, t, None, None, None) for s, q, k, i, t in rows], EVENTS)
    sink = UpsertSink(str(tmp_path / "out"), compact=2)
    assert sink.events(spark) is None and sink.replies(spark) is None
    zero = make([("a", 1, "segment", 0, "x"), ("a", 2, "segment", 0, "y"), ("a", 1, "reply", None, "r")])
    sink.write(zero, 0)
    sink.write(zero, 0)
    assert rows_of(sink, spark) == [("a", "segment", 0, "y")] and sink.replies(spark).count() == 1
    sink.write(make([("a", 3, "segment", 0, "z"), ("a", 4, "segment", 1, "n"), ("b", 1, "end_of_stream", None, None)]), 1)  # and a snapshot
    want = [("a", "segment", 0, "z"), ("a", "segment", 1, "n"), ("b", "end_of_stream", None, None)]
    assert rows_of(sink, spark) == want
    sink.write(zero, 0)
    sink.write(make([]), 2)
    assert rows_of(sink, spark) == want
    sink.write(make([("a", 9, "segment", 1, "m")]), 3)
    assert rows_of(sink, spark) == [want[0], ("a", "segment", 1, "m"), want[2]]


def test_failure_between_write_and_commit(spark, tmp_path):
    """What a failed batch wrote stays unseen, and its rerun counts once."""

    class Failing(UpsertSink):
        broken = True

        def _commit(self, spark, number, kind="commits"):
            if number == 1 and Failing.broken:
                Failing.broken = False
                raise OSError("lost before commit")
            super()._commit(spark, number, kind)

    loud, quiet = [1.0] * 640, [0.0] * 640
    batches = [[("s", 0, "audio", 0, None, loud + quiet, at(1))], [("s", 1, "audio", 0, None, loud + quiet, at(2)), ("s", 2, "open", None, None, None, at(2))], [("s", 3, "close", 0, None, None, at(3)), ("s", 4, "close", 1, None, None, at(3))]]
    said = streamed(spark, tmp_path, batches)
    sink = Failing(str(tmp_path / "out"))

    def run():
        q = said.writeStream.foreachBatch(sink.write).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)

    with pytest.raises(Exception, match="lost before commit"):
        run()
    assert rows_of(sink, spark) == [("s", "segment", 0, "n672 pos")]
    run()
    run()
    assert sorted((r.kind, r.id or 0) for r in sink.events(spark).collect()) == [("end_of_stream", 0), ("segment", 0), ("segment", 1)]
    assert sorted(r.code for r in sink.replies(spark).collect()) == ["closed", "closed", "opened"]
