"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.config import DEVICES, ConfigError, GateConfig, PipelineConfig, parse_device
from wavemill.functions import clock, pcm, tokens
from wavemill.operators import decode, events, features, gate, session, timeline
from wavemill.plans.inputs import chunks, frames, marks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL twins of plans/inputs.py.
CHUNKS = "chunks AS (SELECT CAST(label AS BIGINT) source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, vec_id, embedding samples, len(embedding) n_samples FROM embeddings)"
PLACED = CHUNKS + ", placed AS (SELECT *, CAST(coalesce(sum(n_samples) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start_sample FROM chunks)"
FRAMES = "frames AS (SELECT user_id source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(value / 100, 1.0) prob FROM events)"
MARKS = "marks AS (SELECT user_id source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, event_type, value, CAST((epoch_us(ts) - 1704067200000000) * 1000 AS BIGINT) ts_ns FROM events)"
GATE = FRAMES + """, runs AS (SELECT *, sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY i) gap FROM frames),
gaps0 AS (SELECT source_id, gap, min(CASE WHEN prob >= 0.5 THEN i END) opens, min(CASE WHEN prob < 0.35 THEN i END) a, max(CASE WHEN prob < 0.35 THEN i END) b, max(i) last FROM runs GROUP BY 1, 2),
gaps AS (SELECT *, coalesce((b - a) * 512 >= 1600, false) closed, (max(last) OVER (PARTITION BY source_id) + 1) * 512 total FROM gaps0),
numbered AS (SELECT *, coalesce(sum(CASE WHEN closed AND gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY gap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) nth FROM gaps),
segs AS (SELECT source_id, nth, min(opens) * 512 start_sample, coalesce(max(CASE WHEN closed THEN a END) * 512, max(total)) end_sample FROM numbered WHERE gap > 0 GROUP BY 1, 2),
gated AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_sample) - 1 segment, CAST(start_sample AS BIGINT) start_sample, CAST(end_sample AS BIGINT) end_sample FROM segs WHERE end_sample - start_sample > 4000)"""


def gated(scores: str, frame: int, silence: int, speech: int) -> str:
    """The CTEs of GATE over other frames: ``scores`` must define ``frames``."""
    return scores + GATE.removeprefix(FRAMES).replace("512", str(frame)).replace("1600", str(silence)).replace("4000", str(speech))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- timeline -------------------------------------------------------------------------


@query(f"WITH {PLACED} SELECT source_id, seq, n_samples, start_sample, start_sample * 62500 start_ns FROM placed")
def chunk_timeline(spark, d):
    return timeline.place_chunks(chunks(spark, d)).select("source_id", "seq", "n_samples", "start_sample", "start_ns")


@query(f"WITH {MARKS} SELECT event_id, source_id, first(ts_ns) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) // 62500 AS offset_sample FROM marks")
def anchor_offset(spark, d):
    return timeline.anchor(marks(spark, d)).select("event_id", "source_id", "offset_sample")


@query(f"WITH {MARKS} SELECT event_id, ts_ns, CAST((CAST(ts_ns AS HUGEINT) * 16000) // 1000000000 AS BIGINT) sample, CAST((CAST(ts_ns AS HUGEINT) * 16000) // 1000000000 AS BIGINT) * 62500 quantised_ns FROM marks")
def timestamp_quantise(spark, d):
    sample = clock.ns_to_samples(F.col("ts_ns"))
    return marks(spark, d).select("event_id", "ts_ns", sample.alias("sample"), clock.samples_to_ns(sample).alias("quantised_ns"))


@query(f"""WITH {MARKS}, o AS (SELECT *, first(ts_ns) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) // 62500 + seq * 160 AS expected FROM marks)
SELECT event_id, expected * 62500 expected_ns, ts_ns actual_ns, ts_ns // 62500 = expected ok FROM o""")
def discontinuity(spark, d):
    placed = timeline.place_chunks(timeline.anchor(marks(spark, d)).withColumn("n_samples", F.lit(160)))
    return timeline.check_continuity(placed).select("event_id", "expected_ns", F.col("ts_ns").alias("actual_ns"), "ok")


@query(f"""WITH {MARKS}, s AS (SELECT event_id, ts_ns start_ns, lead(ts_ns) OVER (PARTITION BY source_id ORDER BY seq) end_ns FROM marks)
SELECT event_id, start_ns // 1000000 start_ms, end_ns // 1000000 end_ms, greatest(end_ns - start_ns, 0) // 1000000 duration_ms FROM s WHERE end_ns IS NOT NULL""")
def segment_duration_ms(spark, d):
    end = F.lead("ts_ns").over(W.partitionBy("source_id").orderBy("seq"))
    return events.with_duration(marks(spark, d).select("event_id", F.col("ts_ns").alias("start_ns"), end.alias("end_ns")).where("end_ns is not null")).select("event_id", "start_ms", "end_ms", "duration_ms")


# -- PCM --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(((l_linenumber % 4) + 1) * 8 AS INTEGER) bits, CAST((l_partkey * 37) % 128 AS DOUBLE) / pow(2.0, ((l_linenumber % 4) + 1) * 8 - 1) sample FROM lineitem")
def pcm_normalise(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    bits = ((F.col("l_linenumber") % 4 + 1) * 8).cast("int")
    return li.select("l_orderkey", "l_linenumber", bits.alias("bits"), pcm.normalise(F.col("l_partkey") * 37 % 128, bits).alias("sample"))


@query("SELECT vec_id, CAST(f AS BIGINT) frame, (CAST(embedding[2 * f + 1] AS DOUBLE) + CAST(embedding[2 * f + 2] AS DOUBLE)) / 2 mono FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) f FROM embeddings)")
def downmix(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.posexplode(pcm.downmix(F.col("embedding"), 2)).alias("frame", "mono")).withColumn("frame", F.col("frame").cast("long"))


@query(f"""WITH {PLACED}, flat AS (SELECT source_id, start_sample + k AS loc, samples[k + 1] x FROM (SELECT source_id, start_sample, samples, unnest(range(len(samples))) k FROM placed))
SELECT source_id, loc // 100 AS chunk, count(*) n, CAST(arg_min(x, loc) AS DOUBLE) first_sample, CAST(arg_max(x, loc) AS DOUBLE) last_sample FROM flat GROUP BY 1, 2""")
def rechunk(spark, d):
    out = timeline.rechunk(timeline.place_chunks(chunks(spark, d)), 100)
    return out.select("source_id", "chunk", "n", F.get("samples", F.lit(0)).cast("double").alias("first_sample"), F.element_at("samples", -1).cast("double").alias("last_sample"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 97 frames, CASE WHEN l_linenumber % 2 = 0 THEN 48000 ELSE 44100 END rate, (CAST(l_quantity AS BIGINT) * 97 * 16000 + (CASE WHEN l_linenumber % 2 = 0 THEN 48000 ELSE 44100 END) - 1) // (CASE WHEN l_linenumber % 2 = 0 THEN 48000 ELSE 44100 END) AS out_samples FROM lineitem")
def resample_length(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 97).alias("frames"), F.when(F.col("l_linenumber") % 2 == 0, 48000).otherwise(44100).alias("rate"))
    return li.withColumn("out_samples", pcm.resampled_length(F.col("frames"), F.col("rate")))


@query("SELECT vec_id, CAST(i AS BIGINT) pos, CASE WHEN i = 0 THEN CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[i + 1] AS DOUBLE) - CAST(0.97 AS DOUBLE) * CAST(embedding[i] AS DOUBLE) END y FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) i FROM embeddings)")
def preemphasis(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.posexplode(pcm.preemphasis(F.col("embedding"))).alias("pos", "y")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT i, round(0.5 - 0.5 * cos(2 * pi() * i / 399), 9) w FROM range(400) t(i)")
def hann_window(spark, d):
    return spark.range(pcm.WINDOW).select(F.col("id").alias("i"), F.round(pcm.hann(F.col("id")), 9).alias("w"))


_MEL = "CASE WHEN {m} < 15 THEN {m} * 200.0 / 3 ELSE 1000 * exp(0.06875177742094912 * ({m} - 15)) END"
_TOP = "(15 + ln(CAST(8 AS DOUBLE)) / CAST(0.06875177742094912 AS DOUBLE))"


@query(f"""WITH m AS (SELECT mel, bin, bin * 8000.0 / 256 hz, {_TOP} * mel / 81 a, {_TOP} * (mel + 1) / 81 b, {_TOP} * (mel + 2) / 81 c FROM range(80) x(mel), range(257) y(bin)),
p AS (SELECT mel, bin, hz, {_MEL.format(m='a')} lo, {_MEL.format(m='b')} mid, {_MEL.format(m='c')} hi FROM m)
SELECT mel, bin, round(greatest(0.0, least((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) * 2 / (hi - lo), 9) weight FROM p""")
def mel_filterbank(spark, d):
    return features.mel_filterbank(spark).select("mel", "bin", F.round("weight", 9).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, l_partkey * 31 samples, l_partkey * 31 // 160 + 1 AS n_frames, l_partkey * 31 // 160 AS n_valid FROM lineitem")
def frame_counts(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 31).alias("samples"))
    return li.withColumns({"n_frames": pcm.total_frames(F.col("samples")), "n_valid": pcm.valid_frames(F.col("samples"))})


_DFT = """dft AS (SELECT vec_id, label, bin, sum(x * cos(2 * pi() * bin * k / n)) re, sum(x * sin(2 * pi() * bin * k / n)) im
FROM (SELECT vec_id, label, len(embedding) n, CAST(unnest(embedding) AS DOUBLE) x, unnest(range(len(embedding))) k FROM embeddings), range(33) b(bin) GROUP BY 1, 2, 3)"""


@query(f"WITH {_DFT} SELECT vec_id, bin, round(re * re + im * im, 6) power FROM dft")
def power_spectrum(spark, d):
    return features.power_spectrum(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", "bin", F.round("power", 6).alias("power"))


@query(f"""WITH {_DFT}, l AS (SELECT vec_id, label, bin, ln(re * re + im * im + pow(2.0, -24)) x, row_number() OVER (PARTITION BY label, bin ORDER BY vec_id DESC) > 1 valid FROM dft),
s AS (SELECT label, bin, avg(x) m, coalesce(stddev_samp(x), 0) s FROM l WHERE valid GROUP BY 1, 2)
SELECT vec_id, bin, round(CASE WHEN valid THEN (x - m) / (s + 1e-5) ELSE 0.0 END, 4) + 0.0 feature FROM l JOIN s USING (label, bin)""")
def log_mel_norm(spark, d):
    e = table(spark, d, "embeddings")
    # the last frame of a source is its invalid tail
    tail = e.groupBy("label").agg(F.max("vec_id").alias("tail"))
    power = features.power_spectrum(e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id").join(tail, "label")
    out = features.log_normalised(power.withColumn("valid", F.col("vec_id") != F.col("tail")), ["label", "bin"], "vec_id")
    return out.select("vec_id", "bin", (F.round("feature", 4) + 0.0).alias("feature"))


# -- gate -------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT source_id, i, prob FROM frames WHERE prob >= 0.5")
def vad_threshold(spark, d):
    return frames(spark, d).where("prob >= 0.5")


@query(f"WITH {GATE} SELECT source_id, segment, start_sample, end_sample FROM gated")
def vad_gate(spark, d):
    return gate.segments(frames(spark, d))


flagship = vad_gate


@query(f"""WITH {GATE}, tot AS (SELECT source_id, (max(i) + 1) * 512 total FROM frames GROUP BY 1),
n AS (SELECT *, lag(end_sample) OVER (PARTITION BY source_id ORDER BY start_sample) pe, lead(start_sample) OVER (PARTITION BY source_id ORDER BY start_sample) ns FROM gated),
p AS (SELECT source_id, segment, start_sample s0, CASE WHEN pe IS NULL THEN greatest(start_sample - 480, 0) WHEN start_sample - pe < 960 THEN start_sample - (start_sample - pe) // 2 ELSE start_sample - 480 END s,
CASE WHEN ns IS NULL THEN end_sample + 480 WHEN ns - end_sample < 960 THEN end_sample + (ns - end_sample) // 2 ELSE end_sample + 480 END e FROM n),
c AS (SELECT p.source_id, segment, greatest(s, coalesce(max(e) OVER (PARTITION BY p.source_id ORDER BY s0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) s, least(e, total) e FROM p JOIN tot USING (source_id))
SELECT source_id, segment, s start_sample, e end_sample FROM c WHERE e > s""")
def vad_pad_clamp(spark, d):
    f = frames(spark, d)
    totals = f.groupBy("source_id").agg(((F.max("i") + 1) * 512).alias("total"))
    return gate.pad_and_clamp(gate.segments(f), totals)


_RULES = "prob < 0.35 AND s0 IS NOT NULL AND pos - coalesce(p0, pos) >= 1600"


@query(f"""WITH RECURSIVE {FRAMES.replace('AS (SELECT user_id', 'AS MATERIALIZED (SELECT user_id')},
r AS (SELECT DISTINCT source_id, CAST(-1 AS BIGINT) i, CAST(NULL AS BIGINT) s, CAST(NULL AS BIGINT) p, CAST(NULL AS BIGINT) a, CAST(NULL AS BIGINT) b FROM frames
UNION ALL SELECT source_id, i, CASE WHEN prob >= 0.5 THEN coalesce(s0, pos) WHEN {_RULES} THEN NULL ELSE s0 END, CASE WHEN prob >= 0.5 OR {_RULES} THEN NULL WHEN prob < 0.35 AND s0 IS NOT NULL THEN coalesce(p0, pos) ELSE p0 END,
CASE WHEN cut THEN s WHEN {_RULES} AND coalesce(p0, pos) - s0 > 4000 THEN s0 END, CASE WHEN cut THEN pos WHEN {_RULES} AND coalesce(p0, pos) - s0 > 4000 THEN coalesce(p0, pos) END
FROM (SELECT f.source_id, f.i, f.i * 512 pos, f.prob, r.s, coalesce(f.i * 512 - r.s > 8128, false) cut, CASE WHEN coalesce(f.i * 512 - r.s > 8128, false) THEN NULL ELSE r.s END s0, CASE WHEN coalesce(f.i * 512 - r.s > 8128, false) THEN NULL ELSE r.p END p0 FROM r JOIN frames f ON f.source_id = r.source_id AND f.i = r.i + 1)),
last AS (SELECT source_id, max(i) i FROM frames GROUP BY 1),
found AS (SELECT source_id, a, b FROM r WHERE a IS NOT NULL UNION ALL SELECT source_id, r.s, (r.i + 1) * 512 FROM r JOIN last USING (source_id, i) WHERE (r.i + 1) * 512 - r.s > 4000)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY a) - 1 AS segment, a start_sample, b end_sample FROM found""")
def vad_max_split(spark, d):
    config = GateConfig(max_speech=600_000_000)
    return gate.capped_segments(frames(spark, d), config)


@query(f"""WITH {GATE} SELECT f.source_id, f.i, greatest((f.i + 1) * 512 - 480, 0) keep_from FROM frames f WHERE NOT EXISTS (SELECT 1 FROM gated g WHERE g.source_id = f.source_id AND f.i * 512 >= g.start_sample AND f.i * 512 < g.end_sample)""")
def silence_retention(spark, d):
    """First sample kept after each silent frame: the pad before the frame's end."""
    f = frames(spark, d)
    starts = gate.segments(f).select("source_id", F.col("start_sample").alias("at"), F.col("end_sample").alias("open_until"))
    # the last segment start at or before each frame, by one sorted pass over both
    both = f.select("source_id", (F.col("i") * 512).alias("at"), "i", F.lit(None).cast("long").alias("open_until"), F.lit(1).alias("kind")).unionByName(starts.select("source_id", "at", F.lit(None).cast("long").alias("i"), "open_until", F.lit(0).alias("kind")))
    w = W.partitionBy("source_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last("open_until", ignorenulls=True).over(w)
    return both.withColumn("until", last).where("kind = 1 and (until is null or at >= until)").select("source_id", "i", F.greatest((F.col("i") + 1) * 512 - 480, F.lit(0)).alias("keep_from"))


@query(f"""WITH {PLACED}, t AS (SELECT source_id, sum(n_samples) total FROM chunks GROUP BY 1), seg AS (SELECT source_id, k segment, k * 1000 s, least(k * 1000 + 700, total) e FROM (SELECT source_id, total, unnest(range(CAST(total // 1000 + 1 AS BIGINT))) k FROM t) WHERE k * 1000 < total),
flat AS (SELECT source_id, start_sample + k AS loc, samples[k + 1] x FROM (SELECT source_id, start_sample, samples, unnest(range(len(samples))) k FROM placed))
SELECT s.source_id, segment, CAST(count(*) AS BIGINT) n, CAST(arg_min(x, loc) AS DOUBLE) first_sample, CAST(arg_max(x, loc) AS DOUBLE) last_sample FROM seg s JOIN flat f ON f.source_id = s.source_id AND loc >= s AND loc < e GROUP BY 1, 2""")
def pcm_slice(spark, d):
    """Samples of segments [1000 k, 1000 k + 700): chunks are cut where they overlap one."""
    placed = timeline.place_chunks(chunks(spark, d))
    end = F.col("start_sample") + F.col("n_samples")
    near = placed.withColumn("segment", F.explode(F.sequence(clock.div(F.col("start_sample"), 1000), clock.div(end - 1, 1000))))
    lo = F.greatest("start_sample", F.col("segment") * 1000)
    hi = F.least(end, F.col("segment") * 1000 + 700)
    cut = near.withColumns({"lo": lo, "hi": hi}).where("hi > lo").withColumn("part", F.expr("slice(samples, cast(lo - start_sample + 1 as int), cast(hi - lo as int))"))
    return cut.groupBy("source_id", "segment").agg(F.sum(F.size("part")).cast("long").alias("n"), F.min_by(F.get("part", F.lit(0)), "lo").cast("double").alias("first_sample"), F.max_by(F.element_at("part", -1), "lo").cast("double").alias("last_sample"))


# -- decode --------------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(len(v) - list_position(list_reverse(v), list_max(v)) AS BIGINT) token FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x, 1)) v FROM embeddings)")
def token_argmax_last(spark, d):
    v = F.transform("embedding", lambda x: F.round(x, 1))
    return table(spark, d, "embeddings").select("vec_id", tokens.argmax_last(v).alias("token"))


@query(f"""WITH RECURSIVE {CHUNKS}, steps AS (SELECT source_id, seq t, vec_id % 7 token, (vec_id // 7) % 3 dur FROM chunks), len AS (SELECT source_id, count(*) n FROM steps GROUP BY 1),
w AS (SELECT source_id, CAST(0 AS BIGINT) t FROM len UNION ALL SELECT w.source_id, w.t + CASE WHEN s.dur > 0 THEN s.dur ELSE 1 END FROM w JOIN steps s ON s.source_id = w.source_id AND s.t = w.t)
SELECT w.source_id, w.t AS frame, s.token, CAST(CASE WHEN s.token = 6 THEN 0 WHEN s.dur > 0 THEN 1 ELSE 10 END AS BIGINT) n FROM w JOIN steps s ON s.source_id = w.source_id AND s.t = w.t WHERE s.token <> 6""")
def tdt_walk(spark, d):
    c = chunks(spark, d).select("source_id", "seq", "vec_id")
    steps = c.select("source_id", F.col("seq").alias("frame"), (F.col("vec_id") % 7).alias("token"), (clock.div(F.col("vec_id"), 7) % 3).alias("dur"))
    return decode.transducer_steps(steps, blank=6, longest=2)


_DETOK = """SELECT doc_id, regexp_replace(replace(array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) = 2 THEN '<' || w || '>' WHEN w LIKE 'th%' THEN '▁' || w ELSE w END), lambda t: NOT (t LIKE '<%' AND t LIKE '%>') OR t = '<unk>'), ''), '▁', '{r}'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS detok FROM documents"""


def _pieces():
    return F.transform(F.split("text", " "), lambda w: F.when(F.length(w) == 2, F.concat(F.lit("<"), w, F.lit(">"))).when(w.startswith("th"), F.concat(F.lit("▁"), w)).otherwise(w))


@query(_DETOK.format(r=""))
def detok_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.detokenise(_pieces(), F.lit(False)).alias("detok"))


@query(_DETOK.format(r=" "))
def detok_space(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.detokenise(_pieces(), F.lit(True)).alias("detok"))


# -- events ------------------------------------------------------------------------------------------------


_BLANKED = "b AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 3 THEN U&'\\3000 ' WHEN turn % 7 = 4 THEN ' ' || chr(9) ELSE text END text FROM conversations), kept AS (SELECT * FROM b WHERE regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '')"
_BLANKED = _BLANKED.replace("U&'\\3000 '", "chr(12288) || ' '")


def _turns(spark, d):
    c = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 5 == 3, F.lit("　 ")).when(F.col("turn") % 7 == 4, F.lit(" \t")).otherwise(F.col("text"))
    return c.withColumn("text", text)


@query(f"WITH {_BLANKED} SELECT conv_id, turn, text FROM kept")
def blank_filter(spark, d):
    return events.drop_blank(_turns(spark, d)).select("conv_id", "turn", "text")


@query(f"WITH {_BLANKED} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 id FROM kept")
def segment_ids(spark, d):
    return events.assign_ids(events.drop_blank(_turns(spark, d)), "conv_id", "turn").select("conv_id", "turn", "id")


@query("SELECT conv_id, turn, to_json({'type': 'segment', 'data': {'id': turn, 'source_id': conv_id, 'speaker_id': CAST(NULL AS BIGINT), 'text': text, 'start_ms': turn * 1500, 'end_ms': turn * 1500 + 1200, 'is_final': true}}) AS event FROM conversations")
def event_json(spark, d):
    t = F.col("turn")
    fields = {"id": t, "source_id": F.col("conv_id"), "speaker_id": F.lit(None).cast("long"), "text": F.col("text"), "start_ms": t * 1500, "end_ms": t * 1500 + 1200, "is_final": F.lit(True)}
    return table(spark, d, "conversations").select("conv_id", "turn", events.segment_json(fields).cast("string").alias("event"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    return events.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'microphone' WHEN 'assistant' THEN 'system' ELSE 'unknown' END label FROM conversations")
def source_labels(spark, d):
    labels = spark.createDataFrame([("user", "microphone"), ("assistant", "system")], "role string, label string")
    return events.labelled(table(spark, d, "conversations"), labels, "role").select("conv_id", "turn", "label")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 THEN CAST(i AS DOUBLE) / CAST(a AS DOUBLE) ELSE 0.0 END rtf FROM (SELECT l_orderkey, l_linenumber, l_partkey * 1000 i, (CAST(l_quantity AS BIGINT) - 5) * 1000000 a FROM lineitem)")
def rtf(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000).alias("inference_ns"), ((F.col("l_quantity").cast("long") - 5) * 1_000_000).alias("end_ns"))
    return li.select("l_orderkey", "l_linenumber", events.realtime_factor(F.col("inference_ns"), F.lit(0).cast("long"), F.col("end_ns")).alias("rtf"))


_MOVES = """mv AS MATERIALIZED (SELECT user_id % 20 AS session_id, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) n, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 0 END e, CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END r, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 3 ELSE 0 END d, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END f FROM events)"""
_METRICS = _MOVES + """, met AS (SELECT DISTINCT session_id, CAST(NULL AS BIGINT) event_id, CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) pending, CAST(0 AS BIGINT) peak_pending, CAST(0 AS BIGINT) n_emitted, CAST(0 AS BIGINT) n_received, CAST(0 AS BIGINT) n_discarded, CAST(0 AS BIGINT) n_failures, false receiver_closed FROM mv
UNION ALL SELECT mv.session_id, mv.event_id, mv.n, greatest(pending + e - r - d, 0), greatest(peak_pending, pending + e - r - d), n_emitted + e, n_received + r, n_discarded + d, n_failures + f, receiver_closed OR d > 0 FROM met JOIN mv ON mv.session_id = met.session_id AND mv.n = met.n + 1)"""


def _metrics(spark, d):
    kind = F.col("event_type")
    counts = {"emitted": kind.isin("click", "view", "signup").cast("int"), "received": F.when(kind == "purchase", 2).otherwise(0), "discarded": F.when((kind == "error") & (F.col("event_id") % 3 == 0), 3).otherwise(0), "failures": (kind == "error").cast("int")}
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("session_id"), "event_id", *[c.alias(k) for k, c in counts.items()])
    return events.delivery_metrics(e, "session_id", "event_id")


_COUNTERS = ["pending", "peak_pending", "n_emitted", "n_received", "n_discarded", "n_failures", "receiver_closed"]


@query(f"WITH RECURSIVE {_METRICS} SELECT session_id, event_id, {', '.join(_COUNTERS)} FROM met WHERE n > 0")
def output_metrics(spark, d):
    return _metrics(spark, d).select("session_id", "event_id", *_COUNTERS)


@query(f"""WITH RECURSIVE {_METRICS}, lv AS (SELECT session_id, event_id, peak_pending, CASE WHEN peak_pending < 32 THEN 0 ELSE CAST(floor(log2(peak_pending / 32.0) + 1e-9) AS BIGINT) + 1 END lvl FROM met WHERE n > 0),
pr AS (SELECT *, coalesce(lag(lvl) OVER (PARTITION BY session_id ORDER BY event_id), 0) was FROM lv)
SELECT session_id, event_id, peak_pending, lvl AS level FROM pr WHERE lvl > was""")
def backlog_warnings(spark, d):
    return events.backlog_warnings(_metrics(spark, d), "session_id", "event_id").select("session_id", "event_id", "peak_pending", "level")


@query("SELECT user_id, min(event_id) event_id, arg_min(props, event_id) props FROM events WHERE event_type = 'error' GROUP BY 1")
def first_failure(spark, d):
    return events.first_failure(table(spark, d, "events").where("event_type = 'error'"), "user_id", "props", "event_id")


_OPEN = "event_type IN ('signup', 'click')"


@query(f"""WITH RECURSIVE c AS (SELECT user_id session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n, event_id, CASE WHEN {_OPEN} THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END k FROM events),
r AS (SELECT session_id, CAST(0 AS BIGINT) n, CAST(NULL AS BIGINT) event_id, CAST(1 AS BIGINT) live, CAST(1 AS BIGINT) next_id, CAST(NULL AS BIGINT) source_id, CAST(NULL AS VARCHAR) reply FROM (SELECT DISTINCT session_id FROM c)
UNION ALL SELECT r.session_id, c.n, c.event_id, CASE WHEN k = 1 AND live < 2 THEN live + 1 WHEN k = -1 AND live > 1 THEN live - 1 ELSE live END, CASE WHEN k = 1 AND live < 2 THEN next_id + 1 ELSE next_id END, CASE WHEN k = 1 AND live < 2 THEN next_id END,
CASE WHEN k = 1 AND live < 2 THEN 'opened' WHEN k = 1 THEN 'source_limit' WHEN k = -1 AND live > 1 THEN 'closed' WHEN k = -1 THEN 'source_not_found' ELSE 'none' END FROM r JOIN c ON c.session_id = r.session_id AND c.n = r.n + 1)
SELECT session_id, event_id, live, source_id, reply FROM r WHERE n > 0""")
def source_slots(spark, d):
    kind = F.col("event_type")
    k = F.when(kind.isin("signup", "click"), 1).when(kind.isin("purchase", "error"), -1).otherwise(0)
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", k.alias("k"))
    return session.slots(e, "session_id", ["ts", "event_id"], max_sources=2)


# -- settings ---------------------------------------------------------------------------------------------------


_NAMES = [*DEVICES, " CUDA ", "dml", "trt", "ov", "vitisai", "wgpu", "DNNL", "rocm", "coreml", "azure", "bogus", ""]
_PAIRS = {"dml": "directml", "trt": "tensorrt", "ov": "openvino", "vitisai": "vitis", "wgpu": "webgpu", "dnnl": "onednn"}


def _device(name: str) -> str | None:
    try:
        return parse_device(name)
    except ConfigError:
        return None


@query("SELECT name, CASE WHEN lower(trim(name)) IN (" + ", ".join(f"'{x}'" for x in DEVICES) + ") THEN lower(trim(name)) " + " ".join(f"WHEN lower(trim(name)) = '{a}' THEN '{b}'" for a, b in _PAIRS.items()) + " END device FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") v(name)")
def device_parse(spark, d):
    return spark.createDataFrame([(n, _device(n)) for n in _NAMES], "name string, device string")


_CONFIGS = [(1, "m", 32, 2, 0.5, 250, 30000), (2, "", 0, 0, 9.0, 0, 0), (3, "m", 0, 0, 0.5, 250, 30000), (4, "m", 1, 0, 2.0, 250, 30000), (5, "m", 1, 1, 1.5, 250, 30000), (6, "m", 1, 1, 1.0, 0, 30000), (7, "m", 1, 1, 0.0, 250, 0), (8, "m", 1, 1, 0.5, 250, 341), (9, "m", 1, 1, 0.5, 250, 342)]


def _validate(row: tuple) -> str:
    _, model, capacity, sources, threshold, speech, longest = row
    try:
        PipelineConfig(model, "cpu", capacity, sources, GateConfig(threshold=threshold, min_speech=speech * 1_000_000, max_speech=longest * 1_000_000)).validate()
    except ConfigError as e:
        return str(e).split()[0]
    return "ok"


@query("SELECT id, CASE WHEN m = '' THEN 'model_dir' WHEN c <= 0 THEN 'input_capacity' WHEN s <= 0 THEN 'max_sources' WHEN t < 0 OR t > 1 THEN 'vad_threshold' WHEN sp < 1 THEN 'vad_min_speech' WHEN mx <= 0 OR mx * 16 - 512 - 960 < sp * 16 THEN 'vad_max_speech' ELSE 'ok' END result FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{m}', {c}, {s}, {t}, {sp}, {mx})" for i, m, c, s, t, sp, mx in _CONFIGS) + ") v(id, m, c, s, t, sp, mx)")
def config_validate(spark, d):
    return spark.createDataFrame([(r[0], _validate(r)) for r in _CONFIGS], "id long, result string")


# -- end to end ------------------------------------------------------------------------------------------------------


@query(f"""WITH {PLACED}, t AS (SELECT source_id, seq, start_sample, n_samples, 'n' || n_samples || ' ' || CASE WHEN list_sum(list_transform(samples, lambda x: CAST(x AS DOUBLE))) > 0 THEN 'pos' ELSE 'neg' END AS text FROM placed)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 id, text, start_sample * 62500 start_ns, (start_sample + n_samples) * 62500 end_ns FROM t""")
def asr_fake_e2e(spark, d):
    placed = timeline.place_chunks(chunks(spark, d)).select("source_id", "seq", "start_sample", "n_samples", "samples")
    said = events.drop_blank(decode.transcribe(placed, decode.FakeModel))
    out = events.assign_ids(said, "source_id", "seq")  # each source is a session of its own here
    return out.select("source_id", "id", "text", clock.samples_to_ns(F.col("start_sample")).alias("start_ns"), clock.samples_to_ns(F.col("start_sample") + F.col("n_samples")).alias("end_ns"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from wavemill.plans import audio, models, speech, stream  # noqa: E402,F401  register their queries
