from wavemill.llm import html_text


def one(page, recurring=()):
    root = html_text.parse(page)
    return "\n".join(html_text.blocks(root, html_text.hash_subtrees(root), frozenset(recurring)))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Head</header><nav><ul><li>A</li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <article><h1>Title &amp; more</h1><p><b>One<br>two</b> <i>th</i>ree<p>Four&nbsp;&#228;
    <aside>side</aside><ul><li>x<li>y</ul><div class="comments"><p>nice</p></div></article>
    <div id="cookie-notice">We use</div><form><input></form><footer>&copy; me</footer></body></html>"""
    assert one(page) == "Title & more\nOne two three\nFour ä\nx\ny"


def test_broken_markup():
    assert one("") == "" and one("plain < text") == "plain < text" and one("<p>a<div>b</p>c") == "a\nb\nc"
    assert one("<p>a</b></i>b") == "ab" and one("<script>x") == "" and one("<!-- open") == ""
    assert one("<div>" * 20000 + "deep") == "deep"


def test_recurring_subtrees_go(spark):
    rows = []
    for i in range(40):
        host = "a.example" if i % 4 else "b.example"
        rows.append((i, f"http://{host}/{i}", f"<body><div><p>Welcome to {host}</p></div><div><p>Story {i}</p><p>Second part {i}</p></div><div>Legal text</div></body>", "x"))
    rows += [(100, None, None, "x"), (101, "http://a.example/z", "<article><p>Legal text</p></article><div>Legal text</div>", "x"), (None, "nohost", "<p>k</p>", "x")]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(rows)
    assert got[1].text == "Story 1\nSecond part 1" and got[0].text == "Story 0\nSecond part 0"
    assert got[100].text == "" and got[101].text == "Legal text" and got[None].text == "k" and got[None].n_chars == 1


def test_recurring_subtrees_in_articles_go(spark):
    box = '<div class="x1"><p>Sign up for our letter</p></div>'
    page = '<body><article><h2>Introduction</h2><p>Story {0}, see <a href="/a">About us</a> there</p>%s<p><a href="/b">More of us</a> |</p><table><tr><td>Total</td><td>n {0}</td></tr></table></article></body>' % box
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(30)] + [(100, "http://b.example/", page.format(100))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Introduction\nStory 7, see About us there\nTotal\nn 7"
    assert "Sign up for our letter" in got[100] and "More of us |" in got[100]


def test_all_marked_parts_stay():
    assert one("<body><p>x</p><article><p>a</p></article><div><article>b<article>c</article></article></div><aside><article>d</article></aside></body>") == "a\nb\nc"
    assert one("<main><h1>Head</h1><p>Lead</p><article><p>a</p></article><nav>n</nav><p>End</p></main><p>x</p>") == "Head\nLead\na\nEnd"


def test_copies_count_once_and_hot_hosts_lose_notices(spark):
    copy = "<body><div><h1>One page</h1><p>Its text</p></div>%s</body>"
    rows = [(i, "http://a.example/x", copy % f"<nav>{i}</nav>") for i in range(8)] + [(10 + i, "http://a.example/x", copy % "") for i in range(8)]
    rows += [(100 + i, f"http://hot.example/{i}", f"<body><div><p>Story {i}</p></div>{'<div>We move</div>' if i % 10 == 0 else ''}</body>") for i in range(100)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One page\nIts text" for i in (0, 7, 10, 17))
    assert all(got[100 + i] == f"Story {i}" for i in range(100))


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.main_text(pages).collect():
        assert r.n_chars > 0 and "track(" not in r.text and "©" not in r.text
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_hostile_pages_take_linear_time():
    import time

    pages = ['<a "' * 15000, "<a " * 20000, "<b>" * 8000 + "</i>" * 8000, "<b>" * 8000 + "<p>x" * 8000, '<a ">" ' * 9000, "<a '\">\" ' " * 7000, "<a " + "a" * 60000 + ">", "<a " + "a " * 30000 + ">", "<li><dt>" * 8000, "<" * 60000, "</script " * 7000]
    for page in pages:
        began = time.perf_counter()
        root = html_text.parse(page)
        html_text.blocks(root, html_text.hash_subtrees(root), frozenset())
        assert time.perf_counter() - began < 0.6, page[:20]


def test_tag_ends():
    ends = html_text._Tags('<a x=">" y>z<b "q>r').end
    assert ends(2) == 11 and ends(14) == 18 and html_text._Tags("<a b").end(2) == -1


def shown(spark, rows):
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in got.collect()}


def test_prose_in_articles_stays(spark):
    """Short paragraphs that a few articles of a host share, side by side or not, and one that all hosts share."""
    rows = []
    for i in range(300):
        short = "<p>Yes.</p><p>She said nothing.</p>" if i % 60 == 0 else ""
        rows.append((i, f"http://a.example/{i}", f"<article><h1>T {i}</h1><p>Story {i}</p>{short}<p>More {i}</p>{'<p>No.</p>' if i % 11 == 0 else ''}<p>End {i}</p></article>"))
    for i in range(300, 500):
        rows.append((i, f"http://h{i % 8}.example/{i}", f"<article><p>Story {i}</p>{'<p>A saying.</p>' if i % 3 == 0 else ''}</article>"))
    got = shown(spark, rows)
    assert all("Yes.\nShe said nothing." in got[i] for i in range(0, 300, 60))
    assert all("No." in got[i] for i in range(0, 300, 11))
    assert all("A saying." in got[i] for i in range(300, 500) if i % 3 == 0)


def test_names_match_whole():
    page = '<article><header><h1>Title</h1><p>By me</p></header><div class="social-history"><p>a</p></div><div class="side-effects">b</div><section id="search-theory">c</section><div class="comments-on-plato">d</div><div class="{}">x</div></article>'
    for gone in ("social-share", "side", "ad-300x250", "cookie-notice top", "commentList", "related_posts", "SidebarLeft", "search-form"):
        assert one(page.format(gone)) == "Title\nBy me\na\nb\nc\nd", gone
    assert one(page.format("lead adagio")).endswith("d\nx")
    assert one("<body><header><h1>Site</h1></header><article><header>Just a bar</header><header class='nav'><h2>m</h2></header><p>t</p></article></body>") == "t"


def test_templates_equal_brute_force(spark):
    """The counts in Spark against loops over pages: different surroundings, hosts, places."""
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    pool = [f"<p>s{k}</p>" for k in range(14)]
    rows = []
    for i in range(260):
        host = f"h{rnd.choice([0, 0, 0, 1, 2])}.example"
        parts = [f"<p>own {i % 200}</p>", *rnd.sample(pool[:8], 2)]
        if host == "h0.example":
            parts += ["<p>letter box</p>"] if rnd.random() < 0.5 else []
            parts.insert(0, "<div>lead in</div>") if rnd.random() < 0.3 else None
        body = "".join(parts)
        rows.append((i, f"http://{host}/{i}", f"<article>{body}</article><div>legal</div>" if i % 3 else f"<div>{body}</div><div>legal</div>"))
    least, share, apart, same = 5, 0.2, 8.0, 0.8
    texts, places, bodies = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for _, url, page in rows:
        host = url.split("/")[2]
        bodies[host].add(page)
        root = html_text.parse(page)
        html_text.hash_subtrees(root)
        for c in html_text.candidates(root):
            texts[host, c.digest, c.inside].add(c.other)
            for side in ("before", "after"):
                places[host, c.digest, c.inside][side, getattr(c, side)].add(c.other)
    total = sum(map(len, bodies.values()))
    want = set()
    for (host, digest, inside), other in texts.items():
        if len(other) < least:
            continue
        here = len(other) / len(bodies[host])
        elsewhere = sum(len(o) for (h, d, w), o in texts.items() if w and d == digest and h != host) / (total - len(bodies[host]) + 100)
        if not inside or (here >= share and here >= apart * elsewhere and max(map(len, places[host, digest, True].values())) >= same * len(other)):
            want.add((host, digest, inside))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    seen = pages.select(F.xxhash64(html_text.host_of()).alias("site"), F.xxhash64("html").alias("body"), "html").mapInArrow(html_text._hashes, "site long, body long, digest long, other long, before long, after long, inside boolean")
    names = {r[0]: r[1] for r in spark.createDataFrame([(h,) for h in bodies], "h string").select(F.xxhash64("h"), "h").collect()}
    got = {(names[r.site], r.digest, r.inside) for r in html_text.templates_of(seen, least, share, apart, same).collect()}
    assert got == want and sum(w for *_, w in want) >= 1


def test_edited_copies_keep_their_paragraphs(spark):
    """Versions of one article on a small host, each with another edit, are no template."""
    rows = []
    for i in range(12):
        parts = [f"<p>Part {k} of the one story.</p>" for k in range(20)]
        parts[i % 20] = f"<p>Part {i} was edited {i}.</p>"
        rows.append((i, f"http://a.example/{i}", f"<article>{''.join(parts)}</article>"))
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>Other {i}</p></article>") for i in range(200)]
    got = shown(spark, rows)
    assert all(got[i].count("\n") == 19 for i in range(12))
