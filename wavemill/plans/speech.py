"""Queries of the recognition chain: vocabulary, model files, features, decode, text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions import clock, tokens
from wavemill.operators import decode, events, features, timeline
from wavemill.plans.inputs import chunks, table
from wavemill.plans.registry import _MEL, _TOP, PLACED, query

_LINES = """lines AS (SELECT CAST(c_nationkey AS BIGINT) k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) n, count(*) OVER (PARTITION BY c_nationkey) m, c_custkey, c_name FROM customer),
l AS (SELECT k, n, CASE WHEN k % 9 = 6 OR (k % 9 = 8 AND n = 2) THEN '' WHEN k % 9 = 4 AND n = 2 THEN c_name WHEN k % 9 = 3 AND n = 1 THEN ' 0' WHEN k % 9 = 5 AND n = 2 THEN 'a 18446744073709551616' WHEN k % 9 = 8 AND n = 3 THEN 'a 18446744073709551615'
WHEN k % 9 IN (2, 7) AND n = m THEN '<blk> ' || (n - 1) WHEN k % 9 = 2 AND n = 1 THEN '<blank> 0' ELSE c_name || ' ' || (n - 1 + CASE WHEN k % 9 = 1 AND c_custkey % 5 = 0 THEN 1 ELSE 0 END) END line FROM lines)"""


@query(f"""WITH {_LINES}, t AS (SELECT k, n, line, regexp_matches(line, ' ') sp, reverse(line) rv FROM l WHERE line <> ''),
u AS (SELECT *, CASE WHEN sp THEN left(line, length(line) - instr(rv, ' ')) END tok, CASE WHEN sp THEN TRY_CAST(right(line, instr(rv, ' ') - 1) AS UBIGINT) END id FROM t),
bad AS (SELECT k, arg_min(CASE WHEN NOT sp THEN 'missing_id' WHEN tok = '' THEN 'empty_token' ELSE 'bad_id' END, n) kind FROM u WHERE NOT sp OR tok = '' OR id IS NULL GROUP BY k),
o AS (SELECT k, tok, CAST(id AS HUGEINT) id, row_number() OVER (PARTITION BY k ORDER BY id, n) - 1 p FROM u WHERE sp AND tok <> '' AND id IS NOT NULL),
br AS (SELECT k, arg_min(CASE WHEN id < p THEN 'duplicate_id' ELSE 'gap' END, p) kind FROM o WHERE id <> p GROUP BY k),
bl AS (SELECT k, min(CASE WHEN tok IN ('<blank>', '<blk>') THEN p END) + 1 <> count(*) late, count(*) n FROM o GROUP BY k)
SELECT k vocabulary, CASE WHEN bad.kind IS NOT NULL THEN bad.kind WHEN bl.n IS NULL THEN 'empty' WHEN br.kind IS NOT NULL THEN br.kind WHEN late THEN 'blank_not_last' ELSE 'ok' END result
FROM (SELECT DISTINCT k FROM l) LEFT JOIN bad USING (k) LEFT JOIN br USING (k) LEFT JOIN bl USING (k)""")
def vocab_validate(spark, d):
    """Vocabulary lines made of customers, one vocabulary a nation, most of them broken."""
    w = W.partitionBy("c_nationkey")
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("vocabulary"), F.row_number().over(w.orderBy("c_custkey")).alias("n"), F.count("*").over(w).alias("m"), "c_custkey", "c_name")
    kind, n = F.col("vocabulary") % 9, F.col("n")
    index = n - 1 + F.when((kind == 1) & (F.col("c_custkey") % 5 == 0), 1).otherwise(0)
    line = F.when((kind == 6) | ((kind == 8) & (n == 2)), "").when((kind == 4) & (n == 2), F.col("c_name")).when((kind == 3) & (n == 1), " 0")
    line = line.when((kind == 5) & (n == 2), "a 18446744073709551616").when((kind == 8) & (n == 3), "a 18446744073709551615")
    line = line.when(kind.isin(2, 7) & (n == F.col("m")), F.concat_ws(" ", F.lit("<blk>"), n - 1)).when((kind == 2) & (n == 1), "<blank> 0")
    lines = c.select("vocabulary", "n", line.otherwise(F.concat_ws(" ", "c_name", index)).alias("line"))
    return decode.vocabulary_errors(decode.parse_vocabulary(lines, number="n"), "vocabulary")


_NAMES = ", ".join(f"'{n}'" for n in (*decode.ENCODERS, *decode.DECODERS, "vocab.txt"))


@query(f"""WITH f AS (SELECT CAST(c_custkey // 3 AS BIGINT) dir, list_extract([{_NAMES}], CAST((c_custkey * 5 + c_nationkey) % 8 + 1 AS BIGINT)) nm FROM customer),
g AS (SELECT dir, list(nm) have FROM f GROUP BY 1),
p AS (SELECT dir, {', '.join(f"CASE {' '.join(f'''WHEN list_contains(have, '{n}') THEN '{n}' ''' for n in names)} END {k}" for k, names in (('encoder', decode.ENCODERS), ('decoder_joint', decode.DECODERS)))} FROM g)
SELECT dir, encoder, decoder_joint, CASE WHEN encoder IS NULL THEN 'No encoder model found in ' || dir WHEN decoder_joint IS NULL THEN 'No decoder_joint model found in ' || dir END AS error FROM p""")
def model_files(spark, d):
    names = F.array(*map(F.lit, (*decode.ENCODERS, *decode.DECODERS, "vocab.txt")))
    c = table(spark, d, "customer")  # three files a folder
    return decode.find_model_files(c.select(F.expr("c_custkey div 3").alias("dir"), F.get(names, ((F.col("c_custkey") * 5 + F.col("c_nationkey")) % 8).cast("int")).alias("name")))


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey * 1000 - greatest(l_suppkey * 700 - CAST(l_quantity AS BIGINT) * 500, 0), 0) capture_ns FROM lineitem")
def capture_stamp(spark, d):
    at = clock.capture_time(F.col("l_partkey") * 1000, F.col("l_suppkey") * 700, F.col("l_quantity").cast("long") * 500)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at.alias("capture_ns"))


@query(f"""WITH s AS (SELECT vec_id, unnest(range(64)) i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) x FROM embeddings),
y AS MATERIALIZED (SELECT vec_id, i, x[i + 1] - CASE WHEN i > 0 THEN CAST(0.97 AS DOUBLE) * x[i] ELSE 0 END y FROM s),
fr AS (SELECT vec_id, t, k, y * (0.5 - 0.5 * cos(2 * pi() * (k - 6) / 19)) v FROM range(5) a(t), range(6, 26) b(k), y WHERE i = t * 16 - 16 + k),
ft AS (SELECT vec_id, t, bin, sum(v * cos(2 * pi() * bin * k / 32)) re, sum(v * sin(2 * pi() * bin * k / 32)) im FROM fr, range(17) c(bin) GROUP BY 1, 2, 3),
m AS (SELECT mel, bin, bin * 8000.0 / 16 hz, {_TOP} * mel / 7 a, {_TOP} * (mel + 1) / 7 b, {_TOP} * (mel + 2) / 7 c FROM range(6) x(mel), range(17) z(bin)),
p AS (SELECT mel, bin, hz, {_MEL.format(m='a')} lo, {_MEL.format(m='b')} mid, {_MEL.format(m='c')} hi FROM m),
w AS (SELECT mel, bin, greatest(0.0, least((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) * 2 / (hi - lo) wt FROM p),
g AS (SELECT vec_id, t, mel, ln(sum((re * re + im * im) * wt) + pow(2.0, -24)) x FROM ft JOIN w USING (bin) GROUP BY 1, 2, 3),
n AS (SELECT vec_id, mel, avg(x) mu, stddev_samp(x) sd FROM g WHERE t < 4 GROUP BY 1, 2)
SELECT vec_id, t frame, mel, round(CASE WHEN t < 4 THEN (x - mu) / (sd + 1e-5) ELSE 0.0 END, 4) + 0.0 feature FROM g JOIN n USING (vec_id, mel)""")
def framed_log_mel(spark, d):
    """Log-mel features with hop, window and padding, on small frames."""
    out = features.framed_log_mel(table(spark, d, "embeddings"), "vec_id", "embedding", n_mels=6, n_fft=32, hop=16, window=20)
    return out.select("vec_id", "frame", "mel", (F.round("feature", 4) + 0.0).alias("feature"))


@query(f"""WITH RECURSIVE {PLACED}, u AS MATERIALIZED (SELECT vec_id, list_transform(range(0, 8), lambda t: CAST((floor(1024 * CAST(samples[8 * t + 1] AS DOUBLE)) % 97 + 97) % 97 AS BIGINT)) x FROM placed),
r AS (SELECT vec_id, CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) t, CAST(0 AS BIGINT) emitted, CAST(27 AS BIGINT) prev, CAST(0 AS BIGINT) st, CAST(27 AS BIGINT) tok FROM u
UNION ALL SELECT vec_id, n + 1, CASE WHEN dur > 0 THEN t + dur WHEN tk = 27 OR emitted + 1 >= 10 THEN t + 1 ELSE t END, CASE WHEN dur > 0 OR tk = 27 OR emitted + 1 >= 10 THEN 0 ELSE emitted + 1 END,
CASE WHEN tk = 27 THEN prev ELSE tk END, CASE WHEN tk = 27 THEN st ELSE (2 * st + code + 1) % 7 END, tk
FROM (SELECT r.*, x[t + 1] code, (x[t + 1] + 3 * prev + 5 * st) % 28 tk, (x[t + 1] + prev + st) % 3 dur FROM r JOIN u USING (vec_id) WHERE t < 8)),
v AS (SELECT n_nationkey id, CASE WHEN n_nationkey % 2 = 0 THEN chr(9601) || lower(n_name) ELSE n_name END piece FROM nation),
said AS (SELECT vec_id, trim(replace(string_agg(piece, '' ORDER BY n), chr(9601), ' ')) AS said FROM r JOIN v ON v.id = r.tok WHERE n > 0 GROUP BY 1)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 id, said AS text, start_sample * 62500 start_ns, (start_sample + n_samples) * 62500 end_ns FROM placed JOIN said USING (vec_id) WHERE said <> ''""")
def speech_chain(spark, d):
    """Audio chunks to transcript events: timeline, encoder, greedy decode with state,
    vocabulary look-up, text, blank filter, ids and times."""
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(tokens.MARK), F.lower("n_name"))).otherwise(F.col("n_name")).alias("token"))
    lines = n.unionByName(spark.createDataFrame([(25, "<|en|>")], "n_nationkey long, token string").withColumn("n_nationkey", F.col("n_nationkey").cast(n.schema["n_nationkey"].dataType)))
    parsed = decode.parse_vocabulary(lines.select("n_nationkey", F.concat_ws(" ", "token", "n_nationkey").alias("line")), number="n_nationkey")
    assert decode.vocabulary_errors(parsed).first().result == "ok"
    vocabulary = [r.token for r in parsed.orderBy("token_id").select("token").collect()]  # as large as the model's output
    placed = timeline.place_chunks(chunks(spark, d)).select("source_id", "seq", "start_sample", "n_samples", "samples")
    said = decode.recognise(placed, decode.FakeTransducer, vocabulary)
    said = said.withColumn("text", tokens.detokenise(F.col("pieces"), F.lit(decode.spaces_mode(vocabulary))))
    out = events.assign_ids(events.drop_blank(said), "source_id", "seq")
    return out.select("source_id", "id", "text", clock.samples_to_ns(F.col("start_sample")).alias("start_ns"), clock.samples_to_ns(F.col("start_sample") + F.col("n_samples")).alias("end_ns"))
