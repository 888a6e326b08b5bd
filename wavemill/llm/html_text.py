"""Main text of web pages by removing site templates.

Each page is parsed into elements. An element's subtree is hashed; Spark counts,
per host, the different texts that each hash is surrounded by, so that copies of a
page count once, and subtrees that recur in many surroundings are deleted. Elements whose name, class, id or role
says what they are (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts) go whatever their count. Where a page marks its main part or
articles, all of those are kept and nothing else. There prose recurs too, so a
subtree goes only if it is far more frequent on its host than elsewhere and
keeps its place; headings, cells and items, which many articles share, go only
with what holds them. A recurring phrase stays where other words of its paragraph
stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, prepare, spread

#: Element names by what they do.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
DROPPED = frozenset("script style noscript template nav header footer aside form button input select option textarea iframe object embed svg canvas math video audio dialog menu head title xmp noembed noframes datalist fieldset map".split())
#: What a start tag ends if it is open (within the nearest of the second group).
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
SCOPE = frozenset("html body div article section main aside nav header footer form table ul ol dl blockquote td th".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs sidebar sidebars side widget widgets related recommended recommendations trending popular share shares sharing social comment comments commentlist disqus replies respond footer foot masthead topbar toolbar pagination pager tags skip skiplink hidden search searchbox".split()
)
#: What stands beside such a word in a compound name.
BESIDE = frozenset("list lists box boxes bar bars wrap wrapper container area section block inner outer top bottom left right site page global main primary secondary header head item items link links button buttons btn form posts stories articles slot unit row col column group panel icons media us me this to the in first last sticky fixed small large mobile desktop content thread reply count form".split())
#: Parts of prose that are no template by themselves in an article.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot caption figcaption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form alertdialog".split())
#: Names that some start tag ends.
_ENDED = frozenset().union(*CLOSES.values())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)|<", re.S)
_WORD = re.compile("[0-9][0-9x]*|[A-Z]?[^A-Z0-9_-]+|[A-Z]+")
_EDGE = re.compile("[>\"']")
_ATTR = re.compile(r"(?<![\w:.-])([A-Za-z_:][\w:.-]*+)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|(?<![\w-])(hidden)(?![\w=-])")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0 -     　 \x85]+")


@dataclass
class Node:
    name: str
    label: str
    boiler: bool
    parent: Node | None
    up: Node | None = None  # nearest ancestor in SCOPE or _ENDED
    kids: list = field(default_factory=list)  # Node or str
    digest: int = 0
    words: int = 0  # sum of the hashes of its texts outside template elements


def _boiler(name: str, attrs: str) -> bool:
    if name in DROPPED:
        return True
    if not attrs:
        return False
    found = {}
    for m in _ATTR.finditer(attrs):
        found[(m[1] or m[3]).lower()] = (m[2] or "").strip("\"'")
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    return name not in ("html", "body", "article", "main") and any(_furniture(c) for c in f"{found.get('class', '')} {found.get('id', '')}".split())


@lru_cache(maxsize=1 << 14)
def _furniture(token: str) -> bool:
    """Whether a whole class or id names furniture: all its words are of FURNITURE,
    BESIDE or numbers, and one at least of FURNITURE."""
    words = [w.lower() for w in _WORD.findall(token)]
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in BESIDE or w[0].isdigit() for w in words)


class _Tags:
    """Ends of the tags of a text: the first > outside quotes, or the first at all
    where a quote stays open. A place from which no end was found is not tried again,
    so all tags of a text together take linear time."""

    def __init__(self, text: str):
        self.text, self.dead = text, set()
        self.last = {c: text.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Place after the tag whose name ends at ``at``, or -1."""
        if at > self.last[">"]:
            return -1
        seen, here = [], at
        while m := _EDGE.search(self.text, here):
            q = m.start()
            if m[0] == ">":
                return m.end()
            if q in self.dead or q >= self.last[m[0]]:
                break
            seen.append(q)
            here = self.text.find(m[0], q + 1) + 1
        self.dead.update(seen)
        return self.text.find(">", at) + 1


def parse(text: str) -> Node:
    """A forgiving element tree: unclosed and misnested tags never lose text. It takes
    time linear in the text, whatever its tags."""
    root = Node("", "", False, None)
    here, at, tags, opened = root, 0, _Tags(text), Counter()

    def leave(to: Node) -> Node:
        """Closes ``to`` and all that is open in it."""
        n = here
        while n is not to.parent:
            opened[n.name] -= 1
            n = n.parent
        return n

    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            here.kids.append(text[at:])
            return root
        if m.start() > at:
            here.kids.append(text[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        after = tags.end(at) if name else 0
        if not name or after < 0:
            if m[0] == "<" or after < 0:
                here.kids.append("<")
                at = m.start() + 1
            continue
        attrs, at = text[at : after - 1].strip(), after
        if m[1]:
            if opened[name] > 0:
                open_ = here
                while open_.name != name:
                    open_ = open_.parent
                here = leave(open_)
            elif name == "p":  # a stray end still ends a line
                here.kids.append(Node("p", "p ", False, here))
        else:
            ends = CLOSES.get(name, ())
            if ends:
                open_ = here if here.name in SCOPE or here.name in _ENDED else here.up
                outer = None
                while open_ is not None:
                    if open_.name in ends:
                        outer = open_
                    if open_.name in SCOPE:
                        break
                    open_ = open_.up
                if outer is not None:
                    here = leave(outer)
            marked = here.name in SCOPE or here.name in _ENDED
            node = Node(name, f"{name} {attrs}", _boiler(name, attrs), here, here if marked else here.up)
            here.kids.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}\s*+>", re.I).search(text, at)
                node.kids.append(text[at : end.start() if end else len(text)])
                at = end.end() if end else len(text)
            elif name not in VOID and not attrs.endswith("/"):
                opened[name] += 1
                here = node


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))


_ALL = (1 << 64) - 1


def _text_hash(text: str) -> int:
    text = text.strip(" ")
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) if text else 0


def hash_subtrees(root: Node) -> list[Node]:
    """Sets each node's digest from its label, its texts and its children's digests,
    and the sum of its texts' hashes."""
    nodes = list(_walk(root))
    for n in nodes:
        if n.name == "header" and n.boiler and not _boiler("div", n.label[7:]) and _titles(n):
            n.boiler = False
    for n in reversed(nodes):
        body = [f"{k.digest:x}" if isinstance(k, Node) else _SPACE.sub(" ", k) for k in n.kids]
        if not n.boiler:
            n.words = sum(k.words if isinstance(k, Node) else _text_hash(t) for k, t in zip(n.kids, body)) & _ALL
        n.digest = xxhash.xxh64_intdigest("\x00".join([n.label, *body]).encode("utf-8", "surrogatepass")) - (1 << 63)
    return nodes


def _titles(header: Node) -> bool:
    """Whether a header belongs to a main element or an article and holds a heading."""
    up = header.parent
    while up is not None and up.name not in ("main", "article"):
        up = up.parent
    return up is not None and any(len(n.name) == 2 and n.name[0] == "h" and n.name[1] in "123456" for n in _walk(header))


def _content(root: Node) -> list[Node]:
    """The marked parts: main elements and articles outside template elements and
    outside each other, in order."""
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.name in ("main", "article"):
            found.append(n)
        else:
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node) and not k.boiler)
    return found


def _spared(content: list[Node]) -> set[int]:
    """Ids of nodes that are never templates: mains and articles, what they stand in
    and, within them, ``PARTS``."""
    spared = set()
    for top in content:
        for n in _walk(top):
            if n.name in PARTS:
                spared.add(id(n))
            elif n.name in ("main", "article"):
                up = n
                while up is not None and id(up) not in spared:
                    spared.add(id(up))
                    up = up.parent
    return spared


@dataclass(frozen=True)
class Seen:
    """A subtree on a page: the sum of the page's other texts, whether it stands in a
    marked part, and what stands before and after it in its parent."""

    digest: int
    other: int
    inside: bool
    before: int
    after: int


def _border(parent: Node, side: str) -> int:
    return xxhash.xxh64_intdigest(f"{side} {parent.name}")


def candidates(root: Node) -> list[Seen]:
    """Subtrees that may be deleted, all with text below the body but the spared and
    what goes by name; a page vouches once for each, in and outside marked parts."""
    content = _content(root)
    spared = _spared(content)
    total = sum(n.words for n in content or [root])
    found: dict[tuple[int, bool], Seen] = {}
    tops = {id(n) for n in content}
    stack = [(root, False, 0, 0)]
    while stack:
        n, inside, before, after = stack.pop()
        inside = inside or id(n) in tops
        key = n.digest, inside
        if n.words and id(n) not in spared and n.name not in ("", "html", "body", "head"):
            other = (total - n.words if inside or not content else total) & _ALL
            if key not in found or other < found[key].other:
                found[key] = Seen(n.digest, other, inside, before, after)
        kids = [k for k in n.kids if isinstance(k, Node) and not k.boiler]
        for i, k in enumerate(kids):
            stack.append((k, inside, kids[i - 1].digest if i else _border(n, "start"), kids[i + 1].digest if i + 1 < len(kids) else _border(n, "end")))
    return list(found.values())


_END = object()


def blocks(root: Node, nodes: list[Node], recurring: frozenset[int]) -> list[str]:
    content = _content(root)
    spared = _spared(content)
    out: list[str] = []
    parts: list[str] = []
    rest: list[str] = []  # what stands outside recurring phrases
    inside = 0  # recurring phrases that are open

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text and (len(rest) == len(parts) or any(map(str.isalnum, html.unescape("".join(rest))))):
            out.append(text)
        parts.clear()
        rest.clear()

    stack: list = content[::-1] or [root]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif n is _END:
            inside -= 1
        elif isinstance(n, str):
            parts.append(n)
            if not inside:
                rest.append(n)
        elif n.name == "br":
            parts.append(" ")
            rest.append(" ")
        elif n.boiler:
            flush() if n.name not in INLINE else None
        elif n.digest in recurring and id(n) not in spared:
            if n.name not in INLINE:
                flush()
            else:
                inside += 1
                stack.append(_END)
                stack.extend(reversed(n.kids))
        else:
            if n.name not in INLINE:
                flush()
                stack.append(None)
            stack.extend(reversed(n.kids))
    flush()
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = lambda x: (x & _ALL) - (1 << 63)
    for b in batches:
        rows = []
        for host, body, page in zip(*(b.column(i).to_pylist() for i in range(3))):
            root = parse(page or "")
            hash_subtrees(root)
            rows += [(host, body, c.digest, low(c.other), low(c.before), low(c.after), c.inside) for c in candidates(root)]
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:6]] if rows else [pa.array([], pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[6] for r in rows], pa.bool_())], ["site", "body", "digest", "other", "before", "after", "inside"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for page, recurring in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            root = parse(page or "")
            nodes = hash_subtrees(root)
            text = "\n".join(blocks(root, nodes, frozenset(recurring or ())))
            if recurring and _content(root):
                whole = "\n".join(blocks(root, nodes, frozenset()))
                text = whole if 2 * len(text) < len(whole) else text
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def templates_of(seen: DataFrame, least: int, share: float, apart: float, same: float) -> DataFrame:
    """(site, digest, inside) of the templates in ``seen`` rows; see ``main_text``."""
    texts = seen.select("site", "digest", "inside", "other").distinct().groupBy("site", "digest", "inside").agg(F.count("*").alias("n"))
    often = cut(texts.where(F.col("n") >= least))  # of known size, so that few are broadcast
    size = cut(seen.select("site", "body").distinct().groupBy("site").agg(F.count("*").alias("pages")))
    whole = size.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    within = often.where("inside")
    # the same subtree in marked parts of all hosts
    everywhere = texts.where("inside").join(within.select("digest").distinct(), "digest").groupBy("digest").agg(F.sum("n").alias("n_all"))
    around = seen.where("inside").join(within.select("site", "digest"), ["site", "digest"]).select("site", "digest", "other", "before", "after")
    placed = None
    for side in ("before", "after"):
        one = around.groupBy("site", "digest", side).agg(F.count_distinct("other").alias("k")).groupBy("site", "digest").agg(F.max("k").alias(side))
        placed = one if placed is None else placed.join(one, ["site", "digest"])
    facts = within.join(size, "site").join(everywhere, "digest").join(placed, ["site", "digest"])
    here, elsewhere = F.col("n") / F.col("pages"), (F.col("n_all") - F.col("n")) / (F.lit(whole) - F.col("pages") + 100)
    sure = facts.where((here >= share) & (here >= apart * elsewhere) & (F.greatest("before", "after") >= same * F.col("n")))
    return often.where("not inside").select("site", "digest", "inside").unionByName(sure.select("site", "digest", "inside"))


def main_text(pages: DataFrame, least: int = 5, share: float = 0.2, apart: float = 8.0, same: float = 0.8) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_chars)``, a row per
    input row.

    A subtree outside marked parts is a template if it occurs on pages of its host
    with at least ``least`` different other texts (template elements aside): copies
    of a page, and pages that differ only in it or in menus and the like, count
    once; this number does not grow with the host. Inside an article or main
    element prose may recur, so there it must also be on ``share`` of the host's
    different pages, ``apart`` times as often as on all other hosts (which count
    as 100 pages more), and in ``same`` of the cases after or before the same
    sibling, or first or last in the same kind of parent. Where more than half of
    the marked text would go, the page is an edited copy of others and keeps all. A page travels with
    the templates that occur on it, never with its host's. Null html is empty and
    gives an empty text; a null or hostless url belongs to the empty host. Other
    columns are ignored; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    pages = spread(pages.select("page_id", "url", "html"))
    site = F.xxhash64(host_of())
    body = F.when(F.length("html") > 0, F.xxhash64(host_of(), "html"))
    seen = cut(pages.select(site.alias("site"), body.alias("body"), "html").where("body is not null").mapInArrow(_hashes, "site long, body long, digest long, other long, before long, after long, inside boolean"))
    kept = cut(templates_of(seen, least, share, apart, same))
    # a page with marked parts shows nothing else, others have no inside
    marked = seen.groupBy("body").agg(F.max("inside").alias("marked"))
    used = seen.join(kept, ["site", "digest", "inside"]).groupBy("body", "inside").agg(F.collect_set("digest").alias("recurring"))
    templates = cut(used.join(marked, "body").where("inside = marked").select("body", "recurring"))
    return pages.withColumn("body", body).join(templates, "body", "left").select("page_id", "url", "html", "recurring").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
