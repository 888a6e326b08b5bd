"""URL filter: path rules first, then segmented words and naive Bayes.

Host labels and path parts are often several words run together. A unigram model
of words, counted over hyphenated hosts, hyphenated path segments and page texts
(a name without a mark between its words must not vouch for itself), splits them
by Viterbi; a multinomial naive Bayes model then scores the words of host and path. Its
training urls are those whose separated words hold a seed word of an unwanted
kind (block) and those without one (allow), so it carries the seeds' verdict
over to words that occur with them. All counts are exact Spark tables; urls are
dealt to chunks, and a chunk gets the counts of the words that can occur in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, prepare, spread

#: Seed words of unwanted hosts and paths.
SEEDS = "adult ads bet bets betting bingo casino cheap crack dating escort gambling jackpot keygen loan lottery malware nude payday phishing pharma pharmacy pills poker porn porno replica sex slots spam torrent track tracker viagra warez xxx".split()
#: Fixed values: (host, path, verdict) rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Letters that a word is looked up by, bytes of a chunk of urls, found words held at once.
HEAD, CHUNK_BYTES, HELD = 24, 4 << 20, 1 << 18
#: A tag, closed or cut off by the end, and a character reference.
MARKUP = r"<[/!?a-zA-Z][^>]*+(?:>|\z)|&[a-zA-Z#0-9]{1,8};"
SUBDOMAINS = frozenset("www m blog amp mobile web".split())


def split_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: a rule's host is the url's or
    a parent of it, and its path starts the url's."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segment(name: str, logs: dict[str, float], unknown: float, lengths: list[int] | None = None) -> list[str]:
    """The most probable split of ``name`` into words of the unigram model; an
    unknown word of any length pays ``unknown`` and as much again per two characters.

    ``lengths`` are those of the model's words, longest first. An unknown word's
    price grows evenly, so its best start so far is the best start for every end.
    """
    lengths = sorted({*map(len, logs)}, reverse=True) if lengths is None else lengths
    n = len(name)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    start, ahead = 0, 0.0
    for j in range(1, n + 1):
        if best[j - 1] - unknown * (j - 1) / 2 > ahead:
            start, ahead = j - 1, best[j - 1] - unknown * (j - 1) / 2
        best[j], back[j] = best[start] + unknown * (1 + (j - start) / 2), start
        for size in lengths:
            s = logs.get(name[j - size : j]) if size <= j else None
            if s is not None and best[j - size] + s > best[j]:
                best[j], back[j] = best[j - size] + s, j - size
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


_PARTS = re.compile(r"[^\W_]+")


def named(host: str, path: str) -> list[str]:
    """Parts of a url: host labels but the last and the usual subdomains, and the path's."""
    labels = host.split(":")[0].split(".")
    return [part for label in labels[:-1] if label not in SUBDOMAINS for part in _PARTS.findall(label)] + _PARTS.findall(path.lower())


def tokens(host: str, path: str, splits) -> list[str]:
    """Words of a url: its parts split into words; a number counts as one word."""
    return ["0" if w.isdigit() else w for part in named(host, path) for w in ([part] if part.isdigit() else splits(part))]


class Splitter:
    def __init__(self, logs: dict[str, float], unknown: float):
        self.logs, self.unknown, self.known = logs, unknown, {}
        self.lengths = sorted({*map(len, logs)}, reverse=True)

    def __call__(self, part: str) -> list[str]:
        if len(part) > 255:  # rarely seen twice
            return segment(part, self.logs, self.unknown, self.lengths)
        if part not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[part] = segment(part, self.logs, self.unknown, self.lengths)
        return self.known[part]


def _listed(found: set[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string())], ["of", "head"])


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, first ``HEAD`` letters of a word that can occur) of a batch's urls."""
    for b in batches:
        parts = {(c, part) for c, host, path in zip(*(b.column(i).to_pylist() for i in range(3))) for part in named(host, path) if not part.isdigit()}
        found = set()
        for c, part in parts:
            for i in range(len(part)):
                found.update((c, part[i:j]) for j in range(i + 1, min(len(part), i + HEAD) + 1))
                if len(found) > HELD:
                    yield _listed(found)
                    found = set()
        yield _listed(found)


_SAID = "chunk int, page_id long, host string, path string, words string"


def _tokens(total: int):
    def run(key: tuple, urls: pa.Table, known: pa.Table) -> pa.Table:
        logs = {w: float(np.log(n / total)) for w, n in zip(known.column("w").to_pylist(), known.column("n").to_pylist())}
        split = Splitter(logs, float(np.log(1 / total)))
        words = [" ".join(tokens(host, path, split)) for host, path in zip(urls.column("host").to_pylist(), urls.column("path").to_pylist())]
        return urls.append_column("words", pa.array(words, pa.string()))

    return run


def _scores(prior: float):
    def run(key: tuple, said: pa.Table, known: pa.Table) -> pa.Table:
        weight = dict(zip(known.column("w").to_pylist(), known.column("weight").to_pylist()))
        odds = [prior + sum(weight[w] for w in words.split()) for words in said.column("words").to_pylist()]
        return said.drop_columns("chunk").append_column("log_odds", pa.array(odds, pa.float64()))

    return run


def vocabulary(pages: DataFrame) -> tuple[DataFrame, int]:
    """Counts (w, n) of all words of hyphenated hosts and path segments and of page
    texts, of any length, and the number that probabilities divide by; an unknown
    word counts 1 and the seed words are always known."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " ")
    everything = F.lower(F.concat_ws(" ", text, F.when(F.col("host").contains("-"), F.col("host")), F.array_join(F.regexp_extract_all("path", F.lit("[^/]*[-_+][^/]*"), F.lit(0)), " ")))
    words = pages.select(F.explode(F.split(everything, r"[^\p{L}]+")).alias("w")).where(F.length("w") > 0).where(~F.col("w").isin(*SUBDOMAINS))
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n")))
    seen = {r.w: r.n for r in counts.where(F.col("w").isin(*SEEDS)).collect()}
    seeds = F.create_map(*[F.lit(x) for w in SEEDS for x in (w, max(seen.get(w, 0), 20))])
    counts = counts.where(~F.col("w").isin(*SEEDS)).unionByName(pages.sparkSession.range(1).select(F.explode(seeds).alias("w", "n")))
    total = counts.agg(F.sum("n") + F.count("*")).first()[0]
    # single letters and pairs would swallow every name
    return counts.where((F.length("w") > 2) | (F.col("n") * 200 > total)), int(total)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, host, path, rule, verdict,
    log_odds, words)``, a row per input row.

    A null url, or one without ``://``, has an empty host and path, no rule, and
    is judged by the prior alone. A positive log odds blocks, a tie at zero
    allows; without any seed word in the table nothing is blocked. Urls of any
    length are split whole. Repeated rows are judged alike; other columns are
    ignored; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    host, path = split_url(F.col("url"))
    parts = spread(pages.select("page_id", "url", "html")).select("page_id", host.alias("host"), path.alias("path"), "html")
    # dealt by a random key, so that no host or url is a task of its own
    urls = cut(parts.select("page_id", "host", "path", F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
    size = urls.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    chunks = max(pages.sparkSession.sparkContext.defaultParallelism, size // CHUNK_BYTES)
    urls = urls.select(F.pmod("salt", F.lit(chunks)).cast("int").alias("chunk"), "page_id", "host", "path")
    counts, total = vocabulary(parts)
    # longer words come by their first letters: a chunk may hold some that none of its urls has
    heads = urls.select("chunk", "host", "path").mapInArrow(_substrings, "of int, head string").distinct()
    known = heads.join(counts.withColumn("head", F.left("w", F.lit(HEAD))), "head").select("of", "w", "n")
    said = cut(urls.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_tokens(total), _SAID))
    listed = F.array_remove(F.split("words", " "), "")
    bad = F.arrays_overlap(listed, F.array(*map(F.lit, SEEDS))).cast("long")
    blocked, rows = said.agg(F.sum(bad), F.count("*")).first()
    if blocked:
        spoken = said.select(bad.alias("bad"), F.explode(listed).alias("w")).groupBy("w")
        learned = cut(spoken.agg(F.sum("bad").alias("n1"), F.sum(1 - F.col("bad")).alias("n0")))
        n1, n0, used = learned.agg(F.sum("n1"), F.sum("n0"), F.count("*")).first()
        weight = F.log((F.col("n1") + 1) / (n1 + used)) - F.log((F.col("n0") + 1) / (n0 + used))
        weights = said.select(F.col("chunk").alias("of"), F.explode(listed).alias("w")).distinct().join(learned.select("w", weight.alias("weight")), "w")
        prior = float(np.log((blocked + 1) / (rows - blocked + 1)))
        scored = said.groupBy("chunk").cogroup(weights.groupBy("of")).applyInArrow(_scores(prior), "page_id long, host string, path string, words string, log_odds double")
    else:
        scored = said.withColumn("log_odds", F.lit(-1.0))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "log_odds", "words")
