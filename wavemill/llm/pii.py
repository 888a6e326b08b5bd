"""Personal data spans with DataFrame functions only.

Patterns propose spans, validators confirm them (value ranges, the Luhn sum, the
mod-97 sum), and words near a proposed span decide where the pattern alone is
too weak. Nearby are the 40 characters before a span, whatever spans they hold, and those
after it up to the next match of its kind. Repetitions are possessive and starts are pinned to the beginning of
a run, so the patterns take the same spans as their plain forms in time and
stack that do not grow with a run's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The pattern of each kind; the first four are the base kinds.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ["email", "ip", "card", "phone"]
#: Cheap tests that every text with a span of the kind passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
#: Words that raise a span's score when they stand close before it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|tel|call|fax|mobile",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
#: A confirmed span's score before context, and what context adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_GAIN, ACCEPT, CONTEXT_CHARS = 0.3, 0.5, 40
CHUNK = 128
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """The ISO 7064 check: first four characters last, letters as 10 to 35."""
    s = F.regexp_replace(match, " ", "")
    chars = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(acc)

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_PAIRS = "array<struct<gap:string,hit:string>>"
_NONE = "array<struct<kind:string,start:int,end:int,score:double,hit:string>>"


def _matches(text: Column, kind: str) -> Column:
    """(gap, hit) of each match: the text before it and the match itself."""
    whole = rf"(?s)(.*?)({PATTERNS[kind]}|\z)"
    gaps, hits = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    return F.when(text.rlike(HINTS[kind]), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))


def _chunks(pairs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(pairs) - 1).cast("int"), F.lit(CHUNK)), lambda i: F.slice(pairs, i + 1, CHUNK))


def _starts(chunks: Column) -> Column:
    """Code points before each chunk of matches."""
    sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, p: acc + F.length(p["gap"]) + F.length(p["hit"])))
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], p["hit"])), "")


def _spans(chunks: Column, starts: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order: running lengths of the gaps and hits
    place every match in code points. A match has 5 characters at least, so eight
    before a chunk hold all the characters that are near its first one."""
    empty = F.array().cast(_NONE)

    def step(acc: Column, p: Column) -> Column:
        gap, hit = p["now"]["gap"], p["now"]["hit"]
        start = acc["at"] + F.length(gap)
        before = F.right(F.concat(acc["before"], gap), F.lit(CONTEXT_CHARS))
        after = F.left(F.coalesce(p["next"]["gap"], F.lit("")), F.lit(CONTEXT_CHARS))
        said = F.lower(F.concat_ws("\n", before, after)).rlike(rf"\b(?:{CONTEXT[kind]})")
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(said, CONTEXT_GAIN).otherwise(0.0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), score.alias("score"), hit.alias("hit"))
        keep = (hit != "") & _valid(kind, hit) & ((F.lit(kind in BASE)) | (score >= ACCEPT))
        return F.struct(
            (start + F.length(hit)).alias("at"),
            F.right(F.concat(before, hit), F.lit(CONTEXT_CHARS)).alias("before"),
            F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    def in_chunk(c: Column, i: Column) -> Column:
        earlier = F.when(i > 0, F.right(_joined(F.slice(F.get(chunks, i - 1), -8, 8)), F.lit(CONTEXT_CHARS))).otherwise(F.lit(""))
        following = F.concat(F.slice(c, 2, CHUNK), F.coalesce(F.slice(F.get(chunks, i + 1), 1, 1), F.array().cast(_PAIRS)))
        pairs = F.arrays_zip(c.alias("now"), following.alias("next"))
        return F.aggregate(pairs, F.struct(F.element_at(starts, i + 1).alias("at"), earlier.alias("before"), empty.alias("found")), step, lambda acc: acc["found"])

    return F.coalesce(F.flatten(F.transform(chunks, in_chunk)), empty)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii_spans``: array of (kind, start, end, score, hit), by kind as listed, then start.

    Starts and ends are code points, the end exclusive. A null text is empty.
    Added kinds (iban, ssn) never replace base ones; one that overlaps a base
    span is kept beside it. Base spans are kept whatever their score. Matches
    are placed in chunks, so that the work stays linear in their number.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    name = {k: (f"__pii_{k}_chunks", f"__pii_{k}_starts") for k in PATTERNS}
    out = docs.withColumns({name[k][0]: _matches(t, k) for k in PATTERNS})
    out = out.withColumns({name[k][0]: _chunks(F.col(name[k][0])) for k in PATTERNS})
    out = out.withColumns({name[k][1]: _starts(F.col(name[k][0])) for k in PATTERNS})
    out = out.withColumn("pii_spans", F.concat(*[_spans(F.col(name[k][0]), F.col(name[k][1]), k) for k in PATTERNS]))
    return out.drop(*[c for both in name.values() for c in both])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, counts of base kinds, base_sha256, spans,
    max_score, a row per input row.

    A null or empty text has no spans: counts of 0, the digest of the empty string,
    empty spans and a null score. Texts are searched whole, in time linear in their
    length. Repeated rows and doc_ids, null ones too, are reported row by row. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    found = find_spans(docs.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(BASE))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii_spans")).alias("spans"), F.array_max(F.transform("pii_spans", lambda s: s["score"])).alias("max_score"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; of overlapping
    spans the first to begin, and of those the longest, stands for them. Other
    columns stay, one named pii_spans too; n_chars, if there, follows the new text.
    A null text stays null; rows are neither merged nor dropped, and an empty table
    stays empty.

    Spans are worked on in groups, each on its own stretch of the text, so that a
    long text is not read from its start for every span.
    """
    private = find_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text")))
    order = F.array_sort("pii_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    private = private.withColumn("groups", F.when(F.size("pii_spans") > 0, _chunks(order)))
    # where each group's stretch begins: the farthest end of the spans before it
    ends = F.transform("groups", lambda g: F.array_max(F.transform(g, lambda s: s["end"])))
    private = private.withColumn("from", F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(e, F.element_at(acc, -1))))))

    def in_group(g: Column, i: Column) -> Column:
        begin, end = F.element_at("from", i + 1), F.element_at("from", i + 2)
        stretch = F.substring(F.col("text"), begin + 1, end - begin)

        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(acc["out"], F.substring(acc["text"], acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(piece).alias("out"), acc["text"].alias("text"))

        return F.aggregate(g, F.struct(begin.alias("at"), F.lit("").alias("out"), stretch.alias("text")), step, lambda acc: acc["out"])

    rest = F.substring(F.col("text"), F.element_at("from", -1) + 1, F.length("text"))
    masked = F.when(F.size("pii_spans") > 0, F.concat(F.array_join(F.transform("groups", in_group), ""), rest)).otherwise(F.col("text"))
    fresh = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return private.select("row", masked.alias("masked")).select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
