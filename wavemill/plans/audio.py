"""Queries of the block-wise audio operators: resampling, features over chunk borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.config import GateConfig
from wavemill.functions import tokens
from wavemill.operators import chain, decode
from wavemill.operators import resample as resampling
from wavemill.operators.blocks import place
from wavemill.operators.gate import capped_segments
from wavemill.plans.inputs import chunks, table
from wavemill.plans.registry import _MEL, _TOP, PLACED, gated, query


@query(f"""WITH {PLACED}, flat AS MATERIALIZED (SELECT source_id, start_sample + k AS k, CAST(samples[k + 1] AS DOUBLE) x FROM (SELECT source_id, start_sample, samples, unnest(range(len(samples))) k FROM placed)),
t AS (SELECT source_id, CASE WHEN source_id % 3 = 2 THEN 16000 WHEN source_id % 3 = 1 THEN 48000 ELSE 44100 END rate, count(*) n FROM flat GROUP BY 1),
o AS (SELECT source_id, rate, n, CAST(unnest(range((n * 16000 + rate - 1) // rate)) AS BIGINT) m FROM t),
w AS (SELECT source_id, rate, m, CAST(unnest(range(greatest(CAST(ceil((m / 16000.0 - 0.0068) * rate) AS BIGINT), 0), least(CAST(floor((m / 16000.0 + 0.0068) * rate) AS BIGINT) + 1, n))) AS BIGINT) k FROM o WHERE rate <> 16000),
h AS (SELECT source_id, rate, m, k, CAST(m AS DOUBLE) / 16000 - CAST(k AS DOUBLE) / rate t FROM w),
y AS (SELECT source_id, m, sum(x * CASE WHEN t = 0 THEN 14400 ELSE sin(pi() * 14400 * t) / (pi() * t) END * exp(-t * t / (2 * 0.0008 * 0.0008)) / rate) y FROM h JOIN flat USING (source_id, k) GROUP BY 1, 2
UNION ALL SELECT source_id, k, x FROM flat JOIN t USING (source_id) WHERE rate = 16000)
SELECT source_id, m AS pos, round(y, 6) + 0.0 AS y FROM y""")
def block_resample(spark, d):
    """Embeddings as audio at 44.1, 48 and 16 kHz, brought to 16 kHz block by block."""
    rate = F.when(F.col("source_id") % 3 == 2, 16_000).when(F.col("source_id") % 3 == 1, 48_000).otherwise(44_100)
    out = resampling.resample(chunks(spark, d).select("source_id", "seq", rate.alias("rate"), "samples"))
    flat = out.select("source_id", "start_sample", F.posexplode("samples").alias("i", "y"))
    return flat.select("source_id", (F.col("start_sample") + F.col("i")).alias("pos"), (F.round("y", 6) + 0.0).alias("y"))


#: Short audio needs a short gate: frames of 4 ms, speech over 4 ms, pauses of 8 ms, a pad of 2 ms.
SHORT_GATE = GateConfig(min_speech=4_000_000, min_silence=8_000_000, pad=2_000_000, frame=64)
MELS = 6


def mean_level(frame):
    """The mean sample about one half, as a score."""
    total = F.aggregate(frame, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.size(frame) * 10 + 0.5))


_SCORES = f"""{PLACED}, flat AS MATERIALIZED (SELECT source_id, start_sample + k AS loc, CAST(samples[k + 1] AS DOUBLE) x FROM (SELECT source_id, start_sample, samples, unnest(range(len(samples))) k FROM placed)),
frames AS MATERIALIZED (SELECT source_id, loc // 64 i, least(1.0, greatest(0.0, sum(x) / 64 * 10 + 0.5)) prob FROM flat GROUP BY 1, 2)"""
#: Utterances: padded, clamped segments with their samples on a clock of their own.
_SPEECH = gated(_SCORES, 64, 128, 64) + """,
tot AS (SELECT source_id, count(*) total FROM flat GROUP BY 1),
nb AS (SELECT *, lag(end_sample) OVER (PARTITION BY source_id ORDER BY start_sample) pe, lead(start_sample) OVER (PARTITION BY source_id ORDER BY start_sample) ns FROM gated),
pd AS (SELECT source_id, segment, start_sample s0, CASE WHEN pe IS NULL THEN greatest(start_sample - 32, 0) WHEN start_sample - pe < 64 THEN start_sample - (start_sample - pe) // 2 ELSE start_sample - 32 END s,
CASE WHEN ns IS NULL THEN end_sample + 32 WHEN ns - end_sample < 64 THEN end_sample + (ns - end_sample) // 2 ELSE end_sample + 32 END e FROM nb),
cl AS (SELECT pd.source_id, segment, greatest(s, coalesce(max(e) OVER (PARTITION BY pd.source_id ORDER BY s0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) s, least(e, total) e FROM pd JOIN tot USING (source_id)),
utt AS MATERIALIZED (SELECT source_id, segment, CAST(s AS BIGINT) s, CAST(e AS BIGINT) e, CAST(e - s AS BIGINT) n FROM cl WHERE e > s),
au AS MATERIALIZED (SELECT source_id, segment, n, loc - s AS i, x FROM utt JOIN flat USING (source_id) WHERE loc >= s AND loc < e),
ye AS MATERIALIZED (SELECT source_id, segment, n, i, x - CASE WHEN i > 0 THEN CAST(0.97 AS DOUBLE) * lag(x) OVER (PARTITION BY source_id, segment ORDER BY i) ELSE 0 END y FROM au),
wi AS (SELECT source_id, segment, t, k + 56 AS k, y * (0.5 - 0.5 * cos(2 * pi() * k / 399)) v FROM (SELECT source_id, segment, i, y, CAST(unnest(range(greatest((i + 56 - 256) // 160, 0), least((i + 256) // 160, n // 160) + 1)) AS BIGINT) t FROM (SELECT *, greatest(i, 0) j FROM ye)) z, LATERAL (SELECT i - t * 160 + 256 - 56 k) WHERE k BETWEEN 0 AND 399),
ft AS MATERIALIZED (SELECT source_id, segment, t, bin, sum(v * cos(2 * pi() * bin * k / 512)) re, sum(v * sin(2 * pi() * bin * k / 512)) im FROM wi, range(257) c(bin) GROUP BY ALL),
mp AS (SELECT mel, bin, bin * 8000.0 / 256 hz, {top} * mel / 7 a, {top} * (mel + 1) / 7 b, {top} * (mel + 2) / 7 c FROM range(6) x(mel), range(257) z(bin)),
me AS (SELECT mel, bin, hz, {a} lo, {b} mid, {c} hi FROM mp),
wt AS (SELECT mel, bin, greatest(0.0, least((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) * 2 / (hi - lo) wt FROM me),
lm AS (SELECT source_id, segment, t, mel, ln(sum((re * re + im * im) * wt) + pow(2.0, -24)) x FROM ft JOIN wt USING (bin) GROUP BY ALL),
ms AS (SELECT source_id, segment, mel, avg(x) mu, coalesce(stddev_samp(x), 0) sd FROM lm JOIN utt USING (source_id, segment) WHERE t < n // 160 GROUP BY ALL),
fe AS MATERIALIZED (SELECT lm.source_id, lm.segment, t, lm.mel, t < n // 160 valid, CASE WHEN t < n // 160 THEN (x - mu) / (sd + 1e-5) ELSE 0.0 END f FROM lm JOIN utt USING (source_id, segment) LEFT JOIN ms ON ms.source_id = lm.source_id AND ms.segment = lm.segment AND ms.mel = lm.mel)""".format(top=_TOP, **{k: _MEL.format(m=k) for k in "abc"})


@query(f"WITH {_SPEECH} SELECT source_id, segment, t frame, mel, round(f, 4) + 0.0 feature FROM fe")
def utterance_features(spark, d):
    """Log-mel features, 512 / 160 / 400, of gate segments that are cut across chunks."""
    blocks = chain.speech_features(chunks(spark, d), config=SHORT_GATE, score=mean_level, n_mels=MELS)
    flat = blocks.select("source_id", "segment", "first", F.posexplode("features").alias("k", "f"))
    flat = flat.select("source_id", "segment", (F.col("first") + F.col("k")).alias("frame"), F.posexplode("f").alias("mel", "x"))
    return flat.select("source_id", "segment", "frame", F.col("mel").cast("long").alias("mel"), (F.round("x", 4) + 0.0).alias("feature"))


@query(f"WITH {gated(_SCORES, 64, 128, 64)} SELECT * FROM (SELECT source_id, count(*) n_frames, sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) n_loud FROM frames GROUP BY 1) LEFT JOIN (SELECT source_id, count(*) n_segments, CAST(sum(end_sample - start_sample) AS BIGINT) n_speech FROM gated GROUP BY 1) USING (source_id)")
def gate_over_chunks(spark, d):
    """Scores of frames over chunk borders and what the gate makes of them, by source."""
    frames = chain.scored_frames(place(chunks(spark, d).select("source_id", "seq", "samples")), "source_id", SHORT_GATE.frame, mean_level)
    found = capped_segments(frames, SHORT_GATE).groupBy("source_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("end_sample") - F.col("start_sample")).alias("n_speech"))
    return frames.groupBy("source_id").agg(F.count("*").alias("n_frames"), F.count(F.when(F.col("prob") >= 0.5, 1)).alias("n_loud")).join(found, "source_id", "left")


@query(f"""WITH RECURSIVE {_SPEECH}, st AS MATERIALIZED (SELECT source_id, segment, t, CAST((floor(5 * max(CASE WHEN mel = 0 THEN f END) + 3 * max(CASE WHEN mel = 1 THEN f END) + 7 * max(CASE WHEN mel = 2 THEN f END)) % 97 + 97) % 97 AS BIGINT) code FROM fe WHERE valid GROUP BY ALL),
r AS (SELECT source_id, segment, CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) t, CAST(0 AS BIGINT) emitted, CAST(27 AS BIGINT) prev, CAST(0 AS BIGINT) st, CAST(27 AS BIGINT) tok FROM utt
UNION ALL SELECT source_id, segment, n + 1, CASE WHEN dur > 0 THEN t + dur WHEN tk = 27 OR emitted + 1 >= 10 THEN t + 1 ELSE t END, CASE WHEN dur > 0 OR tk = 27 OR emitted + 1 >= 10 THEN 0 ELSE emitted + 1 END,
CASE WHEN tk = 27 THEN prev ELSE tk END, CASE WHEN tk = 27 THEN st ELSE (2 * st + code + 1) % 7 END, tk
FROM (SELECT r.*, code, (code + 3 * prev + 5 * r.st) % 28 tk, (code + prev + r.st) % 3 dur FROM r JOIN st ON st.source_id = r.source_id AND st.segment = r.segment AND st.t = r.t)),
v AS (SELECT n_nationkey id, CASE WHEN n_nationkey % 2 = 0 THEN chr(9601) || lower(n_name) ELSE n_name END piece FROM nation),
said AS (SELECT source_id, segment, trim(replace(string_agg(piece, '' ORDER BY n), chr(9601), '')) said FROM r JOIN v ON v.id = r.tok WHERE n > 0 GROUP BY 1, 2)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY s) - 1 AS id, said AS text, s * 62500 start_ns, e * 62500 end_ns FROM utt JOIN said USING (source_id, segment) WHERE said <> ''""")
def speech_to_text(spark, d):
    """Audio chunks to transcript events through gate, pre-emphasis and log-mel features."""
    piece = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(tokens.MARK), F.lower("n_name"))).otherwise(F.col("n_name"))
    vocabulary = [r.token for r in table(spark, d, "nation").select("n_nationkey", piece.alias("token")).orderBy("n_nationkey").collect()]  # 25 nations at any size
    return chain.speech_to_text(chunks(spark, d), decode.FeatureTransducer, vocabulary, config=SHORT_GATE, score=mean_level, n_mels=MELS)
