"""Queries of whole sessions: two sources each, opens, closes and vanished senders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import events
from wavemill.plans.audio import SHORT_GATE
from wavemill.plans.inputs import table
from wavemill.plans.registry import gated, query
from wavemill.store import shared_dir
from wavemill.streaming import session
from wavemill.streaming.sink import UpsertSink

#: When closes come, as a number of commands and in seconds; when senders count as gone.
LATE, HOUR, IDLE_MS = 10**12, 3600, 60_000


def mean_score(frame) -> float:
    return min(1.0, max(0.0, 0.5 + 10 * float(frame.mean())))


def session_commands(embeddings: DataFrame, nation: DataFrame) -> DataFrame:
    """Ten sessions: embeddings are the audio of their two sources in turns of three;
    a nation asks its session for a source (one is granted) and, in even
    sessions, closes one, so that odd sessions' senders vanish."""
    at = lambda s: F.timestamp_seconds(F.lit(s)).alias("at")
    none = F.lit(None).cast("long")
    audio = embeddings.select((F.col("label") % 10).cast("string").alias("session_id"), F.col("vec_id").alias("cmd_seq"), F.lit("audio").alias("cmd"), F.expr("vec_id div 3 % 2").alias("source_id"), none.alias("ts_ns"), F.col("embedding").cast("array<float>").alias("samples"), at(1))
    key = F.col("n_nationkey").cast("long")
    opened = F.struct((key - 100).alias("cmd_seq"), F.lit("open").alias("cmd"), none.alias("source_id"), at(1))
    closed = F.struct((key + LATE).alias("cmd_seq"), F.lit("close").alias("cmd"), F.expr("CAST(n_nationkey AS BIGINT) div 10").alias("source_id"), at(HOUR))
    asked = nation.select((key % 10).cast("string").alias("session_id"), F.explode(F.array(opened, closed)).alias("c")).where("c.cmd = 'open' OR CAST(session_id AS INT) % 2 = 0")
    return audio.unionByName(asked.select("session_id", "c.*", none.alias("ts_ns"), F.lit(None).cast("array<float>").alias("samples")))


_SAID = gated("""e AS (SELECT label % 10 AS label, vec_id, vec_id // 3 % 2 src, label % 10 * 2 + vec_id // 3 % 2 source_id, embedding FROM embeddings),
frames AS MATERIALIZED (SELECT source_id, label, src, vec_id, embedding, row_number() OVER (PARTITION BY source_id ORDER BY vec_id) - 1 AS i, least(1.0, greatest(0.0, 0.5 + 10 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64)) prob FROM e)""", 64, 128, 64) + f""",
cf AS (SELECT g.source_id, g.a * 64 end_sample, min(r.i) i FROM gaps g JOIN runs r ON r.source_id = g.source_id AND r.gap = g.gap WHERE g.closed AND g.gap > 0 AND r.prob < 0.35 AND (r.i - g.a) * 64 >= 128 GROUP BY ALL),
tot AS (SELECT source_id, any_value(label) label, any_value(src) src, count(*) * 64 total FROM frames GROUP BY 1),
sg AS (SELECT t.label, t.src, g.source_id, greatest(g.start_sample - 32, 0) lo, least(g.end_sample + 32, total) hi, CASE WHEN f.vec_id IS NOT NULL THEN f.vec_id WHEN label % 2 = 0 THEN {LATE} + label + 10 * src END cmd_seq
FROM gated g JOIN tot t USING (source_id) LEFT JOIN cf ON cf.source_id = g.source_id AND cf.end_sample = g.end_sample LEFT JOIN (SELECT source_id, i, vec_id FROM frames) f ON f.source_id = cf.source_id AND f.i = cf.i),
fl AS (SELECT source_id, i * 64 + k AS loc, CAST(embedding[k + 1] AS DOUBLE) x FROM (SELECT source_id, i, embedding, unnest(range(64)) k FROM frames)),
tx AS (SELECT label, src, lo, hi, cmd_seq, 'n' || (hi - lo) || CASE WHEN sum(x) > 0 THEN ' pos' ELSE ' neg' END AS said FROM sg JOIN fl ON fl.source_id = sg.source_id AND loc >= lo AND loc < hi GROUP BY label, src, lo, hi, cmd_seq),
nk AS (SELECT CAST(n_nationkey AS BIGINT) k, CAST(n_nationkey AS BIGINT) % 10 label FROM nation),
said AS (SELECT CAST(label AS VARCHAR) session_id, cmd_seq, 'segment' kind, row_number() OVER (PARTITION BY label ORDER BY cmd_seq NULLS LAST, src, lo) - 1 id, src source_id, said AS text, lo * 62500 start_ns, hi * 62500 end_ns, CAST(NULL AS VARCHAR) code FROM tx
UNION ALL SELECT CAST(label AS VARCHAR), k - 100, 'reply', NULL, CASE WHEN k < 10 THEN 1 END, NULL, NULL, NULL, CASE WHEN k < 10 THEN 'opened' ELSE 'source_limit' END FROM nk
UNION ALL SELECT CAST(label AS VARCHAR), k + {LATE}, 'reply', NULL, k // 10, NULL, NULL, NULL, 'closed' FROM nk WHERE label % 2 = 0 AND k < 20
UNION ALL SELECT CAST(label AS VARCHAR), CASE WHEN label % 2 = 0 THEN label + 10 + {LATE} END, 'end_of_stream', NULL, NULL, NULL, NULL, NULL, NULL FROM nk WHERE k < 10)"""
_COLUMNS = "session_id, cmd_seq, kind, id, source_id, text, start_ns, end_ns, code"


def _streamed(spark, d) -> tuple[DataFrame, str]:
    """The sessions' events as a stream in a session of its own settings, and a new folder."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    read = lambda name: own.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # noqa: E731  a glob takes a file or a folder
    commands = session_commands(read("embeddings"), read("nation")).withWatermark("at", "0 seconds")
    said = session.transcribe_stream(commands, SHORT_GATE, mean_score, idle_ms=IDLE_MS, event_time=True)
    return said, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(f"WITH {_SAID} SELECT {_COLUMNS} FROM said")
def stream_parity(spark, d):
    """Sessions through the stateful gate: two sources, refused opens, closes, and
    sessions that a timer ends. The stream runs while the query is built, as its
    result is the table that it wrote."""
    said, out = _streamed(spark, d)
    said.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(said.schema).parquet(out)


@query(f"WITH {_SAID} SELECT {_COLUMNS} FROM said WHERE kind <> 'reply'")
def stream_upsert(spark, d):
    """The same sessions through the upsert sink: events merged by id, replies apart."""
    said, out = _streamed(spark, d)
    sink = UpsertSink(out)
    said.writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sink.events(spark)


@query(f"""WITH {_SAID} SELECT e.session_id, e.cmd_seq, coalesce(n.n, 0) n_segments, '{events.END_OF_STREAM}' AS event FROM said e LEFT JOIN (SELECT session_id, count(*) n FROM said WHERE kind = 'segment' GROUP BY 1) n USING (session_id) WHERE e.kind = 'end_of_stream'""")
def end_of_stream(spark, d):
    """The end marker of each session, by its last close or by vanished senders, and the
    segments before it, from the table of commands."""
    commands = session_commands(table(spark, d, "embeddings"), table(spark, d, "nation"))
    said = session.transcribe_table(commands, SHORT_GATE, mean_score, vanish=True)
    ended = said.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "end_of_stream", F.struct("cmd_seq"))).alias("e"), F.count(F.when(F.col("kind") == "segment", 1)).alias("n_segments"))
    return ended.where("e is not null").select("session_id", "e.cmd_seq", "n_segments", F.lit(events.END_OF_STREAM).alias("event"))
