import itertools
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.llm import url_filter as uf


def brute_split(name, logs, unknown):
    best = None
    for cuts in itertools.product([0, 1], repeat=max(0, len(name) - 1)):
        words, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                words.append(name[at:i])
                at = i
        s = sum(logs.get(w, unknown * (1 + len(w) / 2)) for w in words)
        if best is None or s > best[0] + 1e-12:
            best = s, words
    return best


def test_viterbi_equals_enumeration():
    logs = {w: math.log(n / 100) for w, n in {"cheap": 10, "pills": 5, "pill": 8, "the": 30, "s": 1, "he": 9}.items()}
    for name in ("cheappills", "thepill", "xthe", "pillsthe", "zzz", "t"):
        got = uf.segment(name, logs, math.log(1 / 500))
        want = brute_split(name, logs, math.log(1 / 500))
        assert "".join(got) == name
        assert abs(sum(logs.get(w, math.log(1 / 500) * (1 + len(w) / 2)) for w in got) - want[0]) < 1e-9
    assert uf.segment("cheappills", logs, math.log(1 / 500)) == ["cheap", "pills"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=9), st.dictionaries(st.text("ab", min_size=1, max_size=5), st.integers(1, 40), max_size=6))
def test_viterbi_scores_as_enumeration(name, counts):
    total = sum(counts.values()) + len(counts) + 2
    logs, unknown = {w: math.log(n / total) for w, n in counts.items()}, math.log(1 / total)
    got = uf.segment(name, logs, unknown)
    assert "".join(got) == name
    if name:
        assert abs(sum(logs.get(w, unknown * (1 + len(w) / 2)) for w in got) - brute_split(name, logs, unknown)[0]) < 1e-9


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_words(spark):
    urls = [None, "nohost", "http://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://a.www.example.com/en/x", "http://example.com?x=/en/", "x://com", "http://b.net/es/1#f", "http://net/fr/", "http://notexample.org/en/", "http://a.com:80/", "://", "http://cheappills.org/buy/now", "http://cheap-pills.org/buy/now", "http://pleasant.org/buy/", "http://pleasant.org/garden/", "http://É.org/\n/ä"]
    urls += ["http://cheap-pills.org/offer/1"] * 5 + ["http://pleasant.org/garden/9"] * 30
    rows = [(i, u, "<p>pleasant cheap garden</p>", "h") for i, u in enumerate(urls)] + [(None, "http://" + "q" * 5000 + ".org/", None, "h")]
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    by = {urls[r.page_id]: r for r in got if r.page_id is not None}
    assert by["http://cheappills.org/buy/now"].words.startswith("cheap pills") and by["http://cheappills.org/buy/now"].verdict == "block"
    assert by["http://cheap-pills.org/offer/1"].verdict == "block" and by["http://pleasant.org/garden/"].verdict == "allow" and by[None].verdict == "allow"


def test_path_parts_are_split(spark):
    long = "bestonlinecasinobonuses"
    far = "online" * 42 + "casino" + "best" * 10  # the seed word lies across character 255
    urls = [f"http://x.org/{long}/1", f"http://x.org/a/{long}foryou", f"http://x.org/a/{long}online", f"http://y.org/{far}", "http://y.org/" + "7" * 30] + ["http://pleasant.org/garden/9"] * 30
    rows = [(i, u, "<p>best online bonuses for you, pleasant garden</p>") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].words == "x best online casino bonuses 0" and got[0].verdict == "block"
    assert got[1].words.split()[-3:] == ["bonuses", "for", "you"] and got[2].words.split()[-2:] == ["bonuses", "online"]
    assert "casino" in got[3].words.split() and got[3].words.replace(" ", "") == "y" + far and got[4].words == "y 0"
    assert got[10].verdict == "allow"


def test_all_words_count(spark):
    common = ["q" + "".join(chr(97 + i // 16**k % 16) for k in range(4)) for i in range(50_500)]
    rows = [(0, "http://zebrulonwyvertix.org/", " ".join(common * 2) + " zebrulon wyvertix")]
    assert uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).first().words == "zebrulon wyvertix"
    # two words that crc32 puts in one of 65,536 slots keep their own counts
    at = zlib.crc32(b"gardenia") % 65536
    other = next(w for w in map("".join, itertools.product("abcdefgh", repeat=8)) if zlib.crc32(w.encode()) % 65536 == at)
    urls = ["http://x.org/casino/gardenia"] * 10 + [f"http://x.org/{other}"] * 10 + ["http://x.org/gardenia"]
    rows = [(i, u, f"gardenia {other}") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 21 and got[20].words == "x gardenia" and got[10].words == f"x {other}" and got[20].log_odds > got[10].log_odds + 1


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_words_and_long_tags(spark):
    word = "donaudampfschifffahrtsgesellschaft"  # 34 letters
    tag = '<a title="' + "hidden " * 600 + '">'
    rows = [(0, f"http://kapitan{word}.org/x", f"{tag}kapitan {word} garden</a> 1 < 2 garden"), (1, "http://" + "z" * 70 + ".org/", "<b unclosed hidden"), (2, "http://hiddengarden.org/", None)]
    rows += [(3 + i, f"http://h{i}.org/", f"kapitan {word} garden") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = {r.w: r.n for r in uf.vocabulary(pages.select("html", F.lit("").alias("host"), F.lit("").alias("path")))[0].collect()}
    assert counts[word] == 6 and counts["garden"] == 7 and "hidden" not in counts
    got = {r.page_id: r.words for r in uf.judge(pages).collect()}
    assert got[0] == f"kapitan {word} x" and got[1] == "z" * 70 and got[2] == "hidden garden"


def test_scores_equal_counting_and_differ_from_the_seed_list(spark):
    urls = ["http://luckywheel.org/casino/bonus"] * 6 + ["http://luckywheel.net/bonus/"] * 3 + ["http://luckywheel.org/bonus/9"] + ["http://pleasant.org/garden/9"] * 30
    urls += ["http://pleasant.org/garden/spam/garden/garden/9", None]
    rows = [(i, u, "<p>lucky wheel bonus pleasant garden lucky wheel</p>") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    said = {i: r.words.split() for i, r in got.items()}
    bad = {i: bool(set(ws) & set(uf.SEEDS)) for i, ws in said.items()}
    n1, n0 = (Counter(w for i, ws in said.items() if bad[i] == side for w in ws) for side in (True, False))
    used = len({*n1, *n0})
    prior = math.log((sum(bad.values()) + 1) / (len(said) - sum(bad.values()) + 1))
    for i, r in got.items():
        want = prior + sum(math.log((n1[w] + 1) / (n1.total() + used)) - math.log((n0[w] + 1) / (n0.total() + used)) for w in said[i])
        assert abs(r.log_odds - want) < 1e-9 and (r.rule is not None or r.verdict == ("block" if want > 0 else "allow"))
    # blocked by its words without any seed word, allowed in spite of one
    assert not bad[9] and got[9].verdict == "block" and bad[40] and got[40].verdict == "allow"
