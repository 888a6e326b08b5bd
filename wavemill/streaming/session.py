"""Sessions as a stream: ordered commands in, segments, replies and errors out.

Commands of a session are handled in ``cmd_seq`` order: open, audio, close and
cancel. Per source the state holds its clock, its open segment and, in chunks,
the samples that a segment may still need; in silence that is the pad and a
partial frame. A session whose senders are silent for long is flushed by a timer:
its sources in opening order, then the end of the stream. The same steps serve
Structured Streaming and batch tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wavemill.config import GateConfig, samples_of_ms
from wavemill.functions.clock import SAMPLE_NS
from wavemill.operators.decode import AsrModel, FakeModel
from wavemill.streaming.buffer import Buffer, RangeError

#: The last nanosecond and sample of a session's time.
LAST_NS = (1 << 63) - 1
OUTPUT = "session_id string, cmd_seq long, kind string, id long, source_id long, text string, start_ns long, end_ns long, code string"
Scorer = Callable[[np.ndarray], float]


def energy_score(frame: np.ndarray) -> float:
    """A deterministic stand-in for a voice network: loudness squashed to 0..1."""
    return float(min(1.0, np.sqrt(np.mean(np.square(frame, dtype=np.float64))) * 5))


@dataclass
class Source:
    """``tail`` are the samples from ``scored`` on, less than a frame."""

    clock: int = 0
    offset: int | None = None
    start: int | None = None
    pending: int | None = None
    last_end: int = 0
    scored: int = 0
    tail: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    buffer: Buffer = field(default_factory=Buffer)


@dataclass
class Session:
    sources: dict[int, Source]
    next_source: int = 1
    next_id: int = 0
    over: bool = False
    deadline: int = -1


class Gate:
    """The voice-activity rules over a source's growing samples."""

    def __init__(self, config: GateConfig, scorer: Scorer):
        self.c, self.scorer = config, scorer
        self.silence, self.speech, self.pad = (samples_of_ms(x) for x in (config.min_silence, config.min_speech, config.pad))
        self.cap = samples_of_ms(config.max_speech) - config.frame - 2 * self.pad

    def _take(self, s: Source, start: int, end: int) -> tuple[int, int, np.ndarray] | None:
        lo, hi = max(start - self.pad, s.last_end, s.buffer.base), min(end + self.pad, s.buffer.end)
        if hi <= lo:
            return None
        s.last_end = hi
        return lo, hi, s.buffer.take(lo, hi)

    def push(self, s: Source, samples: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        s.buffer.append(s.buffer.end, samples)
        x, at = np.concatenate((s.tail, samples)), s.scored
        whole = len(x) // self.c.frame * self.c.frame
        for i in range(0, whole, self.c.frame):
            yield from self._frame(s, at + i, x[i : i + self.c.frame])
        s.scored, s.tail = at + whole, x[whole:]
        s.buffer.trim((s.scored if s.start is None else s.start) - self.pad)

    def finish(self, s: Source) -> Iterator[tuple[int, int, np.ndarray]]:
        total = s.buffer.end
        if len(s.tail):  # the last frame is filled up with zeros
            yield from self._frame(s, s.scored, np.pad(s.tail, (0, self.c.frame - len(s.tail))))
        if s.start is not None and total - s.start > self.speech:
            got = self._take(s, s.start, total)
            if got:
                yield got
        s.start = s.pending = None
        s.scored, s.tail = total, s.tail[:0]
        s.buffer.trim(total)

    def _frame(self, s: Source, at: int, frame: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        p, end = self.scorer(frame), None
        if s.start is not None and at - s.start > self.cap:
            end = at
        if end is None and p < self.c.threshold - self.c.neg_gap and s.start is not None:
            s.pending = at if s.pending is None else s.pending
            end = s.pending if at - s.pending >= self.silence else None
        if end is not None:
            got = self._take(s, s.start, end) if end - s.start > self.speech else None
            s.start = s.pending = None
            if got:
                yield got
        if p >= self.c.threshold:
            s.start, s.pending = at if s.start is None else s.start, None


class TimeError(ValueError):
    """A time past the session's last nanosecond."""

    code = "invalid_timestamp"


class Handler:
    """One command at a time; yields output rows without the session's key."""

    def __init__(self, gate: Gate, model: AsrModel, max_sources: int):
        self.gate, self.model, self.max_sources = gate, model, max_sources

    @staticmethod
    def _row(seq, kind, id=None, source=None, text=None, start=None, end=None, code=None):
        return (seq, kind, id, source, text, start, end, code)

    def _say(self, session: Session, seq: int, number: int, s: Source, found) -> Iterator[tuple]:
        for lo, hi, pcm in found:
            text = self.model.transcribe([pcm])[0]
            if not text.strip():
                continue
            off = s.offset or 0
            session.next_id += 1
            if (off + hi) * SAMPLE_NS > LAST_NS:
                raise TimeError
            yield self._row(seq, "segment", session.next_id - 1, number, text, (off + lo) * SAMPLE_NS, (off + hi) * SAMPLE_NS)

    def handle(self, session: Session, seq: int, cmd: str, number: int | None, ts_ns: int | None, samples) -> Iterator[tuple]:
        """A command's rows. After an error nothing more of the session is handled."""
        if session.over:
            return
        try:
            yield from self._command(session, seq, cmd, number, ts_ns, samples)
        except (RangeError, TimeError) as e:
            session.over = True
            yield self._row(seq, "error", source=number, code=e.code)

    def vanish(self, session: Session) -> Iterator[tuple]:
        """The senders are gone: open sources are flushed in opening order, then the
        stream ends, once. These rows follow from no command and have no cmd_seq."""
        if session.over:
            return
        session.over = True
        for number in sorted(session.sources):
            s = session.sources.pop(number)
            try:
                yield from self._say(session, None, number, s, self.gate.finish(s))
            except (RangeError, TimeError) as e:
                yield self._row(None, "error", source=number, code=e.code)
                return
        yield self._row(None, "end_of_stream")

    def _command(self, session: Session, seq: int, cmd: str, number: int | None, ts_ns: int | None, samples) -> Iterator[tuple]:
        if cmd == "cancel":
            session.over = True
        elif cmd == "open":
            if len(session.sources) >= self.max_sources:
                yield self._row(seq, "reply", code="source_limit")
            else:
                session.sources[session.next_source] = Source()
                yield self._row(seq, "reply", source=session.next_source, code="opened")
                session.next_source += 1
        elif cmd == "audio":
            s = session.sources.get(number)
            if s is None:
                session.over = True
                yield self._row(seq, "error", source=number, code="source_not_found")
                return
            at = None if ts_ns is None else ts_ns // SAMPLE_NS
            if s.offset is None:
                s.offset = at or 0
            elif at is not None and (s.offset + s.clock) * SAMPLE_NS > LAST_NS:
                raise TimeError
            elif at is not None and at != s.offset + s.clock:
                session.over = True
                yield self._row(seq, "error", source=number, start=(s.offset + s.clock) * SAMPLE_NS, end=ts_ns, code="timestamp_discontinuity")
                return
            x = np.asarray(samples if samples is not None else [], np.float32)
            s.clock += len(x)
            yield from self._say(session, seq, number, s, self.gate.push(s, x))
        elif cmd == "close":
            s = session.sources.pop(number, None)
            if s is None:
                yield self._row(seq, "reply", source=number, code="source_not_found")
                return
            yield from self._say(session, seq, number, s, self.gate.finish(s))
            yield self._row(seq, "reply", source=number, code="closed")
            if not session.sources:
                session.over = True
                yield self._row(seq, "end_of_stream")


def new_session() -> Session:
    return Session({0: Source()})


_COLUMNS = ["session_id", "cmd_seq", "kind", "id", "source_id", "text", "start_ns", "end_ns", "code"]


def _frame_of(key, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(key, *r) for r in rows], columns=_COLUMNS)
    return out.astype({c: "Int64" for c in ("cmd_seq", "id", "source_id", "start_ns", "end_ns")})


def _commands(pdf: pd.DataFrame) -> Iterator[tuple]:
    for r in pdf.sort_values("cmd_seq").itertuples(index=False):
        number, ts = (None if pd.isna(v) else int(v) for v in (r.source_id, r.ts_ns))
        yield int(r.cmd_seq), r.cmd, number, ts, r.samples


class _Samples:
    """A source's chunks in the map state."""

    def __init__(self, state, number: int):
        self.state, self.number = state, number

    def get(self, start: int) -> np.ndarray:
        return np.frombuffer(bytes(self.state.getValue((self.number, start))[0]), np.float32)

    def put(self, start: int, samples: np.ndarray) -> None:
        self.state.updateValue((self.number, start), (samples.tobytes(),))

    def remove(self, start: int) -> None:
        self.state.removeKey((self.number, start))


class SessionProcessor(StatefulProcessor):
    """Keyed by session: one value for the session, one map entry per live source, and
    one per chunk of samples that a source still needs. With ``idle_ms`` a timer
    flushes a session that long after its last trigger with commands."""

    def __init__(self, config: GateConfig, scorer: Scorer, model: Callable[[], AsrModel], max_sources: int, idle_ms: int | None = None, event_time: bool = False):
        self.settings = config, scorer, model, max_sources
        self.idle_ms, self.event_time = idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        config, scorer, model, most = self.settings
        self.handle_, self.handler = handle, Handler(Gate(config, scorer), model(), most)
        self.session = handle.getValueState("session", "next_source long, next_id long, over boolean, deadline long")
        self.sources = handle.getMapState("sources", "number long", "clock long, anchored long, start long, pending long, last_end long, scored long, tail binary, base long, end long, first long")
        self.samples = handle.getMapState("samples", "number long, start long", "pcm binary")

    def _load(self) -> Session:
        state = new_session()
        if self.session.exists():
            state.next_source, state.next_id, state.over, state.deadline = self.session.get()
            state.sources = {}
            for (number,), v in sorted(self.sources.iterator(), key=lambda kv: kv[0][0]):
                clock, anchored, start, pending, last_end, scored, tail, base, end, first = v
                state.sources[number] = Source(clock, *(None if x < 0 else x for x in (anchored, start, pending)), last_end, scored, np.frombuffer(bytes(tail), np.float32), Buffer(base, end, first))
        for number, s in state.sources.items():
            s.buffer.store = _Samples(self.samples, number)
        return state

    def _save(self, state: Session, before: dict[int, Source]) -> None:
        for number, s in before.items():
            if number not in state.sources:
                s.buffer.trim(s.buffer.end)
                s.buffer.commit()
                if self.sources.containsKey((number,)):
                    self.sources.removeKey((number,))
        for number, s in state.sources.items():
            s.buffer.store = _Samples(self.samples, number)
            s.buffer.commit()
            b = s.buffer
            self.sources.updateValue((number,), (s.clock, *(-1 if x is None else int(x) for x in (s.offset, s.start, s.pending)), int(s.last_end), int(s.scored), s.tail.astype(np.float32).tobytes(), int(b.base), int(b.end), int(b.first)))
        self.session.update((state.next_source, state.next_id, state.over, state.deadline))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        before, pdf = dict(state.sources), pd.concat(list(rows))
        for command in _commands(pdf):
            out.extend(self.handler.handle(state, *command))
        if self.idle_ms is not None:
            now = int(pdf["at_ms"].max()) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if state.deadline >= 0:
                self.handle_.deleteTimer(state.deadline)
            state.deadline = -1 if state.over else max(now + self.idle_ms, state.deadline)
            if not state.over:
                self.handle_.registerTimer(state.deadline)
        self._save(state, before)
        yield _frame_of(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        before, out = dict(state.sources), list(self.handler.vanish(state))
        state.deadline = -1
        self._save(state, before)
        yield _frame_of(key[0], out)

    def close(self) -> None:
        pass


def transcribe_stream(commands: DataFrame, config: GateConfig = GateConfig(), scorer: Scorer = energy_score, model: Callable[[], AsrModel] = FakeModel, max_sources: int = 2, idle_ms: int | None = None, event_time: bool = False) -> DataFrame:
    """A streaming ``commands`` table to its events; needs the RocksDB state store.

    With ``idle_ms`` a session without commands for so long is flushed and ended:
    by the clock, or with ``event_time`` by the watermark on the commands' ``at``,
    which must have one. Commands of an ended session are ignored.
    """
    if event_time:
        commands = commands.withColumn("at_ms", F.unix_millis("at"))
    mode = "None" if idle_ms is None else "EventTime" if event_time else "ProcessingTime"
    return commands.groupBy("session_id").transformWithStateInPandas(SessionProcessor(config, scorer, model, max_sources, idle_ms, event_time), OUTPUT, "Append", mode)


def transcribe_table(commands: DataFrame, config: GateConfig = GateConfig(), scorer: Scorer = energy_score, model: Callable[[], AsrModel] = FakeModel, max_sources: int = 2, vanish: bool = False) -> DataFrame:
    """The same over a static table, as its sorted rows stream by; with ``vanish`` the
    senders are gone after a session's last command."""
    columns = ["session_id", "cmd_seq", "cmd", "source_id", "ts_ns", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handler, now, state = Handler(Gate(config, scorer), model(), max_sources), None, None
        for batch in batches:
            out = []
            audio = batch.column(5)
            for i, (key, *command) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if state is None or key != now:
                    out += [(now, *r) for r in handler.vanish(state)] if vanish and state else []
                    now, state = key, new_session()
                samples = audio[i].values.to_numpy(zero_copy_only=False) if audio[i].is_valid else None
                out += [(key, *r) for r in handler.handle(state, *command, samples)]
            yield _batch_of(out)
        if vanish and state:
            yield _batch_of([(now, *r) for r in handler.vanish(state)])

    return commands.select(columns).repartition("session_id").sortWithinPartitions("session_id", "cmd_seq").mapInArrow(run, OUTPUT)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _COLUMNS)
