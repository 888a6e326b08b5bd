"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, ego_join, html_text, langid, max_tree, mixing, mixing_lm, packing, pii, topk, url_filter
from .base import table
from .parity_join import jaccard_components


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embeddings_top_k(table(spark, sf_dir, "embeddings"), k=10, scale=1024, every=100)


def op4_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op5_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_texts(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_topk, op3_langid, op4_ego_join, op5_mixing_lm, op6_pii, op7_html_text, op8_mixing, op9_url_filter, op10_parity_join, op11_divergence, op12_decontaminate, op13_max_tree)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHOLE = "vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

SQL = {
    "op2_topk": f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) v FROM embeddings WHERE {_WHOLE}),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 10""",
    "op4_ego_join": f"""
WITH RECURSIVE d AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings WHERE {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) u FROM d),
l AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.9),
c(vec_id, reach) AS (SELECT vec_id, vec_id FROM u UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.reach),
n AS (SELECT a, count(*) n FROM l GROUP BY a), m AS (SELECT vec_id, min(reach) low FROM c GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0) n_links, coalesce(m.low, e.vec_id) component_id, coalesce(e.vec_id = coalesce(m.low, e.vec_id), false) kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.vec_id = e.vec_id""",
    "op10_parity_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i+2], ' '))) END g FROM w),
f AS (SELECT DISTINCT doc_id, unnest(g) s FROM g WHERE doc_id IS NOT NULL),
n AS (SELECT doc_id, count(*) n FROM f GROUP BY 1),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) i FROM f x JOIN f y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
c(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.reach),
m AS (SELECT doc_id, min(reach) low FROM c GROUP BY 1)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) n_shingles, coalesce(m.low, g.doc_id) component_id FROM g LEFT JOIN m ON m.doc_id = g.doc_id""",
    "op11_divergence": rf"""
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) term FROM d),
k AS (SELECT lang, term, count(*) total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) n FROM o GROUP BY ALL),
v AS (SELECT lang, count(*) v, sum(total) whole FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, k.total, v.v, v.whole FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) p, 1 + (1000000000::HUGEINT * (total + 1)) // (whole + v) q FROM x),
s AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(s.f, 0) f FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' part, term item, (p - q) * (p - q) // q f FROM p WHERE n > 0 AND p > q),
u AS (SELECT * FROM pair UNION ALL SELECT * FROM term),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) rk FROM u)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(rk AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rk <= 200""",
    "op12_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i+9], ' '))) key FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM i),
n AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) spot, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i+size-1], ' '))) key FROM d JOIN s ON len(w) >= size),
m AS (SELECT n.r, n.spot, n.size, i.item_id FROM n JOIN i ON i.key = n.key AND i.size = n.size),
h AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(spot, spot + size)) p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) ids FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, coalesce(h.n_hit, 0) n_hit, coalesce(t.n_items, 0) n_items, sha256(coalesce(t.ids, '')) items_sha256, coalesce(h.n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r""",
    "op13_max_tree": rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) times FROM b GROUP BY ALL),
s AS (SELECT count(*) n_docs, sum(len(w)) n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) tf FROM (SELECT r, unnest(w) term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) w FROM tf, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_terms m FROM d, s WHERE len(w) > 0),
c AS (SELECT q.item_id, m.r, any_value(m.doc_id) doc_id, CAST(sum(q.times * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) score FROM q JOIN df ON df.term = q.term JOIN tf ON tf.term = q.term JOIN m ON m.r = tf.r GROUP BY q.item_id, m.r),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rk FROM c WHERE score > 0)
SELECT item_id, CAST(rk AS INTEGER) AS rank, doc_id, score FROM z WHERE rk <= 20""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
