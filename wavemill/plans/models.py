"""Queries of model-side work: graph contracts, recurrent scores, files, and the SQL re-chunker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavemill.functions import tables
from wavemill.operators import contract, recurrent
from wavemill.operators.contract import OUTLETS
from wavemill.plans.inputs import chunks, frames, table
from wavemill.plans.registry import CHUNKS, FRAMES, PLACED, query
from wavemill.sources.wav_source import WavSource, write_wav
from wavemill.store import shared_dir

#: Sound shapes of the outlets in the order of OUTLETS, with what each customer's models do to one of them.
_SHAPES = ([-1, 80, -1], [-1], [-1, 512, -1], [1], [1, 512, 1], [1, 1], [1], [2, 1, 640], [2, -1, 640], [1, 1, -1, 1030], [2, 1, 640], [2, 1, 640])
_SOUND = [(i, place, location, name, kind, shape) for i, ((place, location, name, kind, *_), shape) in enumerate(zip(OUTLETS, _SHAPES))]
_N = len(_SOUND)
_ROWS = ", ".join(f"({i}, {p}, '{loc}', '{n}', '{k}', {s}::BIGINT[])" for i, p, loc, n, k, s in _SOUND)


@query(f"""WITH o(i, place, loc, nm, kd, sh) AS (VALUES {_ROWS}),
c AS (SELECT c_custkey model, o.*, CASE WHEN o.i = c_custkey % {_N} THEN (c_custkey // {_N}) % 9 WHEN o.i = c_nationkey % {_N} AND c_custkey % 3 = 0 THEN (c_custkey // 7) % 9 ELSE 0 END m FROM customer, o),
t AS (SELECT model, i, place, kd want, CASE WHEN m = 2 THEN 'f64' ELSE kd END kd, CASE m WHEN 3 THEN list_append(sh, 1) WHEN 4 THEN [-1] || sh[2:] WHEN 5 THEN [0] || sh[2:] WHEN 6 THEN [7] || sh[2:] WHEN 7 THEN sh[1:1] || [-1] || sh[3:] WHEN 8 THEN sh[1:1] || [3] || sh[3:] ELSE sh END s, m <> 1 has FROM c),
n AS (SELECT model, place, CASE WHEN NOT has THEN 'missing' WHEN kd <> want THEN 'type' WHEN place <> 11 AND len(s) <> CASE WHEN place IN (1, 3, 8) THEN 1 WHEN place = 7 THEN 2 ELSE 3 END THEN 'rank'
WHEN place = 11 THEN NULL WHEN s[1] = 0 THEN 'invalid' WHEN s[1] <> -1 AND s[1] <> CASE WHEN place IN (9, 10, 13, 14) THEN 2 ELSE 1 END THEN 'size'
WHEN place IN (7, 9, 10, 13, 14) AND s[2] NOT IN (-1, 1) THEN 'size' WHEN place = 6 AND s[3] NOT IN (-1, 1) THEN 'size' WHEN place IN (9, 10, 13, 14) AND s[3] NOT IN (-1, 640) THEN 'size' END p FROM t
UNION ALL SELECT model, 4, CASE WHEN s[2] = -1 THEN 'dynamic_feature' END FROM t WHERE place = 0 AND has
UNION ALL SELECT model, 12, CASE WHEN len(list_filter(s[:-2], lambda d: d <> 1 AND d <> -1)) > 0 THEN 'several' WHEN s[-1] <> -1 AND s[-1] < 1025 THEN 'too_small' END FROM t WHERE place = 11 AND has
UNION ALL SELECT e.model, 15, CASE WHEN e.s[2] > 0 AND d.s[2] > 0 AND e.s[2] <> d.s[2] THEN 'mismatch' END FROM t e JOIN t d ON d.model = e.model WHERE e.place = 2 AND e.has AND d.place = 6 AND d.has),
f AS (SELECT model, min(place) outlet, arg_min(p, place) problem FROM n WHERE p IS NOT NULL GROUP BY 1),
z AS (SELECT model, max(CASE WHEN place = 0 THEN s[2] END) fs, max(CASE WHEN place = 2 AND s[2] > 0 THEN s[2] END) a, max(CASE WHEN place = 6 AND s[2] > 0 THEN s[2] END) b FROM t GROUP BY 1)
SELECT z.model, f.outlet, f.problem, CASE WHEN f.outlet IS NULL THEN fs END feature_size, CASE WHEN f.outlet IS NULL THEN coalesce(a, b) END encoded_size FROM z LEFT JOIN f ON f.model = z.model""")
def graph_contract(spark, d):
    """Contracts of customers' models, each with one or two outlets broken in its own way."""
    listed = [F.struct(F.lit(i).alias("i"), F.lit(loc).alias("location"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.array(*[F.lit(v).cast("long") for v in s]).alias("sound")) for i, _, loc, n, k, s in _SOUND]
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), "c_nationkey", F.inline(F.array(*listed)))
    own, other = F.expr(f"c_custkey div {_N} % 9".replace("c_custkey", "model")), F.expr("model div 7 % 9")
    m = F.when(F.col("i") == F.col("model") % _N, own).when((F.col("i") == F.col("c_nationkey") % _N) & (F.col("model") % 3 == 0), other).otherwise(0)
    head = lambda v: F.concat(F.array(F.lit(v).cast("long")), F.slice("sound", 2, 9))
    second = lambda v: F.concat(F.slice("sound", 1, 1), F.array(F.lit(v).cast("long")), F.slice("sound", 3, 9))
    x = x.withColumn("m", m).where("m <> 1")
    shape = F.when(F.col("m") == 3, F.array_append("sound", F.lit(1).cast("long"))).when(F.col("m") == 4, head(-1)).when(F.col("m") == 5, head(0)).when(F.col("m") == 6, head(7)).when(F.col("m") == 7, second(-1)).when(F.col("m") == 8, second(3)).otherwise(F.col("sound"))
    tensors = x.select("model", "location", "name", F.when(F.col("m") == 2, "f64").otherwise(F.col("kind")).alias("dtype"), shape.alias("shape"))
    out = contract.check_contracts(tensors, 1024)
    return out.withColumn("outlet", F.col("outlet").cast("int"))


@query(f"""WITH RECURSIVE {FRAMES.replace('AS (SELECT user_id', 'AS MATERIALIZED (SELECT user_id')},
r AS (SELECT DISTINCT source_id, CAST(-1 AS BIGINT) i, CAST(0 AS DOUBLE) h1, CAST(0 AS DOUBLE) h2 FROM frames
UNION ALL SELECT f.source_id, f.i, tanh(0.6::DOUBLE * h1 - 0.3::DOUBLE * h2 + 2 * f.prob - 0.4::DOUBLE), tanh(0.2::DOUBLE * h1 + 0.5::DOUBLE * h2 + f.prob + 0.1::DOUBLE) FROM r JOIN frames f ON f.source_id = r.source_id AND f.i = r.i + 1)
SELECT source_id, i, round(1 / (1 + exp(-(3 * h1 - h2 + 0.2::DOUBLE))), 6) prob FROM r WHERE i >= 0""")
def recurrent_scores(spark, d):
    """Events as inputs of a recurrent cell, a state for each user."""
    out = recurrent.score(frames(spark, d), inputs="prob")
    return out.select("source_id", "i", F.round("prob", 6).alias("prob"))


@query(f"""WITH {PLACED} SELECT source_id, CAST(start_sample + k AS BIGINT) pos, greatest(-32768, least(32767, floor(CAST(samples[k + 1] AS DOUBLE) * 32768 + 0.5))) / 32768.0 AS sample FROM (SELECT source_id, start_sample, samples, unnest(range(len(samples))) k FROM placed)""")
def wav_splits(spark, d):
    """Embeddings written as WAV files and read back, each file in splits of 512 samples."""
    out = f"{shared_dir(spark)}/wav-{uuid.uuid4().hex}"
    write_wav(chunks(spark, d), out).write.format("noop").mode("overwrite").save()
    spark.dataSource.register(WavSource)
    read = spark.read.format("wav_pcm").option("chunk", 100).option("split", 512).load(out)
    source, part = (F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.wav$", i).cast("long") for i in (1, 2))
    flat = read.select(source.alias("source_id"), part.alias("part"), "seq", F.posexplode("samples").alias("i", "x"))
    # every chunk of the table is 64 samples, so a part of 2^16 chunks is 2^22 samples
    return flat.select("source_id", (F.col("part") * (1 << 22) + F.col("seq") * 100 + F.col("i")).alias("pos"), F.col("x").cast("double").alias("sample"))


@query(f"""WITH {CHUNKS}, flat AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq, k) - 1 AS loc, x FROM (SELECT source_id, seq, unnest(samples) x, unnest(range(len(samples))) k FROM chunks))
SELECT source_id, loc // 150 AS chunk, count(*) n, CAST(sum(CAST(x AS DOUBLE)) AS DECIMAL(18, 6)) total FROM flat GROUP BY 1, 2""")
def rechunk_sql(spark, d):
    """The re-chunking table function in SQL."""
    tables.register(spark)
    chunks(spark, d).select("source_id", "seq", "samples").createOrReplaceTempView("wavemill_chunks")
    out = spark.sql("SELECT * FROM rechunk(TABLE(wavemill_chunks), 150)")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("source_id", "chunk", "n", total.cast("decimal(18,6)").alias("total"))
