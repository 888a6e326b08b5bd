import hashlib
import random
import re

from wavemill.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t[:200], got[i].spans, joined)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert got[i].spans.startswith(joined)


def test_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(3)
    fixed = [None, "", "a@b.c", "é😀 x@y.zz 10.0.0.1 +1 (988) 555-2485 4111 1111 1111 1111", "a@b.com_x@c.org", "a@b@c.d", "1.2.3.4.5.6.7.8", "999.1.1.1 0000255.1.1.1", "12  3 4111-1111-1111-1111 5", "+1 2+3 4 5 6 7 8 9 0 1 2"]
    noise = ["".join(rnd.choice("ab@@..+- 0123456789()_\né") for _ in range(rnd.randrange(1, 120))) for _ in range(400)]
    check(spark, fixed + noise)


def test_long_runs_are_safe(spark):
    # the plain patterns take quadratic time here, so the counts are stated
    texts = ["1" * 200000, "1 " * 60000, "a" * 200000, "a@" + ".b" * 60000, "a@b" + ".c" * 60000, "1." * 20000, "+1" + "(" * 60000]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(0, 0, 0, 0)] * 4 + [(1, 0, 0, 0), (0, 5000, 0, 0), (0, 0, 0, 0)]


def test_added_kinds(spark):
    df = spark.createDataFrame([(1, "iban DE89 3702 0504 4000 1000 00 x DE89370400440532013000"), (2, "my ssn 123-45-6789, part 123-45-6789" + " " * 50 + "123-45-6789")], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert "iban:35:57" in rows[1] and rows[1].count("iban") == 1
    assert rows[2].count("ssn") == 2


def test_mask(spark):
    df = spark.createDataFrame([(1, "to a@b.co now", 13, "k"), (2, None, None, None), (3, "plain", 5, None)], "doc_id long, text string, n_chars long, source string")
    rows = {r.doc_id: r for r in pii.mask(df).collect()}
    assert rows[1].text == "to [EMAIL] now" and rows[1].n_chars == 14 and rows[2].text is None and rows[3].text == "plain"
    assert pii.mask(df).columns == df.columns


def test_context_over_many_spans_and_after_a_span(spark):
    text = "ssn " + ", ".join(f"123-45-{6000 + i}" for i in range(400))
    rows = [(1, text), (2, "123-45-6789 is my social number"), (3, "123-45-6789 and more"), (4, "ssn " + "x" * 37 + " 123-45-6789")]
    got = {r.doc_id: r.spans.count("ssn") for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the word stands within 40 characters of the first three
    assert got == {1: 3, 2: 1, 3: 0, 4: 0}


def test_chunks_of_matches_keep_their_context(spark):
    for k in range(120, 132):
        text = ", ".join(f"123-45-{6000 + i}" for i in range(k)) + " ssn 123-45-6789, 123-45-6788"
        (row,) = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert row.spans.count("ssn") == 3  # the two after the word, and the one before it


def test_empty_repeated_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).collect() == [] and pii.mask(none).collect() == []
    rows = [(1, "a@b.co", 7, 1, "z"), (1, "a@b.co", 7, 1, "z"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans int, `from` int, `a.b` string")
    got = pii.report(df).collect()
    assert sorted(r.n_email for r in got) == [0, 1, 1] and len({r.base_sha256 for r in got}) == 2
    masked = pii.mask(df)
    assert masked.columns == df.columns
    assert sorted(tuple(map(str, r)) for r in masked.collect()) == sorted(tuple(map(str, r[:1] + ("[EMAIL]" if r[1] else None,) + r[2:])) for r in rows)


def test_mask_equals_a_plain_loop(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a@b.co", " ", "1.2.3.4", "+1 988 555 24 85", "x", "é😀", "4111 1111 1111 1111", "\n"]) for _ in range(rnd.randrange(1, 900))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.pii_spans for r in pii.find_spans(df).collect()}
    for r in pii.mask(df).collect():
        at, out, text = 0, [], texts[r.doc_id]
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out.append(text[at : s.start] + f"[{s.kind.upper()}]")
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:]
