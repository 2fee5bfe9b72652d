"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of elements. Each element has a hidden state, main text or not; its tag, its class and id words
and the shape of its text depend on the state, the state on its parent's. Messages pass from the leaves up and from
the root down; their product is each element's exact marginal, and the text of elements that are more likely main than
not is the page's. The tables of the model are counts over labelled pages. Map-only: a task holds one page's tree.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content; that hold no text of the page; that begin and end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head".split())
#: What a page's head may hold; anything else ends it.
_HEAD = frozenset("title meta link script style base noscript template".split())
BLOCK = frozenset(
    "html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary"
    " table tbody td textarea tfoot th thead tr ul".split()
)
#: The start of one of these ends an open element of those, up to the bounds.
_CLOSES_P = BLOCK - frozenset("html body caption td th tr tbody thead tfoot option legend button select textarea".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}


#: The count that each word of a class or id has beforehand under either state: small, as such words tell a lot.
RARE = 0.02
#: The count that each word of running text's class has beforehand: larger, as a paragraph of an article may have any.
NOTE = 1.0
#: The count that each shape of text has beforehand: large, as labelled pages cannot show them all.
SHAPE = 50.0
#: The count that each share of text has beforehand.
PLACE = 5.0


#: Elements that make up a page, and lists and tables that a class, id or role names. All others are running text: they
#: hardly ever begin or end the main text, so they have transitions and words of their own, and as siblings look alike
#: their evidence counts for a part only.
STRUCTURE = frozenset(
    "#root html body nav header footer aside section article main form fieldset legend label input button select option"
    " textarea datalist dialog menu search hgroup address details iframe object div".split()
)
LISTS = frozenset("ul ol dl table".split())
PART = 0.15


def plain(n: "Node") -> bool:
    return n.tag not in STRUCTURE and not (n.tag in LISTS and any(n.attrs.get(a) for a in ("class", "id", "role")))


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list = []  # texts and children in page order
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {}, None)
        self.open: Counter[str] = Counter()  # open elements by tag

    def _leave(self, node: Node) -> None:
        """Close node and what is open in it."""
        while self.now is not node:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent
        self.open[node.tag] -= 1
        self.now = node.parent

    def _close(self, tags, bounds) -> None:
        """Close the outermost open element of tags that is inside the innermost of bounds. Without an open one nothing
        is searched, so deep pages take linear time."""
        if not any(self.open[t] for t in tags):
            return
        at, found = self.now, None
        left = sum(self.open[t] for t in tags)
        while left and at.parent and at.tag not in bounds:
            if at.tag in tags:
                found, left = at, left - 1
            at = at.parent
        if found:
            self._leave(found)

    def _inside(self, tag: str) -> None:
        """Go into html or body, made where the page leaves them out."""
        while self.now.parent and self.now.tag != "html":
            self._leave(self.now)
        if self.now.tag != "html":
            self.now = next((c for c in self.root.children if c.tag == "html"), None) or Node("html", {}, self.root)
        if tag == "body":
            self.now = next((c for c in self.now.children if c.tag == "body"), None) or Node("body", {}, self.now)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.now.tag == "head" and tag not in _HEAD:
            self._leave(self.now)
        if tag in ("html", "body"):
            named = {k: v or "" for k, v in attrs}
            if self.now.tag in ("#root", "html"):
                self._inside(tag)
                self.now.attrs = named | self.now.attrs
            else:  # a second one only adds attributes
                at = self.now
                while at.parent and at.tag != tag:
                    at = at.parent
                at.attrs = named | at.attrs
            return
        if self.now.tag in ("#root", "html") and tag not in _HEAD and tag != "head":
            self._inside("body")
        if tag in _CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "caption", "table"} if tag != "table" else {"button", "td", "th", "caption"})
        if tag in _SIBLINGS:
            self._close(*_SIBLINGS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag and tag not in ("html", "body"):
            self._leave(self.now)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.open[tag]:  # what comes after those still belongs to the page
            return
        at = self.now
        while at.parent and at.tag != tag:
            if tag not in BLOCK and at.tag in BLOCK:  # an inline end tag closes nothing outside its block
                return
            at = at.parent
        if at.parent:
            self._leave(at)

    def handle_data(self, data: str) -> None:
        if self.now.tag in ("#root", "html", "head") and data.strip():
            if self.now.tag == "head":
                self._leave(self.now)
            self._inside("body")
        self.now.parts.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def ordered(root: Node) -> list[Node]:
    """Parents before children, in page order; hidden elements left out."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if c.tag not in HIDDEN)
    return out


_WORDS = re.compile(r"[a-z]+").findall
_STOPS = re.compile(r"[.!?。！？]")


def _step(share: float) -> str:
    return "0" if share < 0.1 else "1" if share < 0.3 else "2" if share < 0.6 else "3"


def observed(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each node: tag, words of its class, id and role, its text's length, links and sentences; of those
    that make up a page also how much of the page's text they have, and how much of theirs is running text right below."""
    size, linked, stops, links, below = {}, {}, {}, {}, {}
    for n in reversed(nodes):
        own = [p for p in n.parts if isinstance(p, str)]
        mine = sum(len(p.strip()) for p in own)
        size[n] = mine + sum(size.get(c, 0) for c in n.children)
        below[n] = mine + sum(below.get(c, 0) for c in n.children if plain(c))
        stops[n] = sum(len(_STOPS.findall(p)) for p in own) + sum(stops.get(c, 0) for c in n.children)
        links[n] = (n.tag == "a") + sum(links.get(c, 0) for c in n.children)
        linked[n] = size[n] if n.tag == "a" else sum(linked.get(c, 0) for c in n.children)
    whole = max(1, size[nodes[0]])
    inside: dict[Node, bool] = {}
    out = []
    for n in nodes:
        inside[n] = n.tag in ("article", "main") or bool(n.parent) and inside[n.parent]
        page, text = n.tag in ("#root", "html", "body"), plain(n)
        seen = [f"tag={n.tag}" + ("/inside" if n.tag in ("header", "hgroup") and inside[n] else "")]
        kind = "note" if text else "word"
        seen += sorted({f"{kind}={w}" for a in ("class", "id", "role") for w in _WORDS(n.attrs.get(a, "").lower())})
        if n.tag in BLOCK or n.tag == "#root":
            k = size[n]
            seen.append("size=" + ("0" if not k else "1" if k < 25 else "2" if k < 100 else "3" if k < 400 else "4"))
            share = linked[n] / k if k else 0.0
            seen.append("links=" + ("0" if not links[n] else "1" if share < 0.3 else "2" if share < 0.7 else "3"))
            seen.append("stops=" + ("0" if not stops[n] else "1" if stops[n] < 3 else "2"))
        if not text:
            if n.tag == "body" or not page:
                seen.append(("page" if page else "part") + "-below=" + _step(below[n] / size[n] if size[n] else 0.0))
            if not page:
                seen.append("of-page=" + _step(size[n] / whole))
        out.append(seen)
    return out


class Model:
    """Log tables from smoothed counts: root (state), edge (whether plain, parent's state, own state), seen (feature:
    state)."""

    def __init__(self, pages: list[str], prior: float = 0.5) -> None:
        root, edge = [prior, prior], [[[prior, prior], [prior, prior]] for _ in range(2)]
        seen: dict[str, list[float]] = {}
        kinds: dict[str, list[float]] = {}
        for page in pages:
            nodes = ordered(parse(page))
            state: dict[Node, int] = {}
            for n, found in zip(nodes, observed(nodes), strict=True):
                said = n.attrs.get("data-main")
                state[n] = y = int(said) if said is not None else state[n.parent] if n.parent else 0
                if n.parent:
                    edge[plain(n)][state[n.parent]][y] += 1
                else:
                    root[y] += 1
                for f in found:
                    seen.setdefault(f, [0, 0])[y] += 1
                    kinds.setdefault(f.partition("=")[0], [0, 0])[y] += 1
        log = lambda x: [math.log(v / sum(x)) for v in x]
        self.root, self.edge = log(root), [[log(x) for x in e] for e in edge]
        # words are many and rare, so each tells as much as its own counts; other kinds have one value per element
        values = {k: sum(f.startswith(f"{k}=") for f in seen) for k in kinds}
        self.seen = {}
        for f, c in seen.items():
            k = f.partition("=")[0]
            p = {"word": RARE, "note": NOTE, "size": SHAPE, "links": SHAPE, "stops": SHAPE, "tag": prior}.get(k, PLACE)
            self.seen[f] = [math.log((c[y] + p) / (kinds[k][y] + p * values[k])) for y in (0, 1)]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of main text at each node, by sum-product over the tree."""
        place = {n: i for i, n in enumerate(nodes)}
        up = [[0.0, 0.0] for _ in nodes]  # own evidence and all messages from below
        sent = [[0.0, 0.0] for _ in nodes]  # message to the parent
        edges = [self.edge[plain(n)] for n in nodes]
        for i, found in enumerate(observed(nodes)):
            part = PART if plain(nodes[i]) else 1.0
            for f in found:
                if t := self.seen.get(f):
                    up[i][0] += part * t[0]
                    up[i][1] += part * t[1]
        for i in range(len(nodes) - 1, 0, -1):
            (a, b), edge = up[i], edges[i]
            m = [_add(edge[y][0] + a, edge[y][1] + b) for y in (0, 1)]
            sent[i] = m
            j = place[nodes[i].parent]
            up[j][0] += m[0]
            up[j][1] += m[1]
        down = [[0.0, 0.0] for _ in nodes]
        down[0] = list(self.root)
        out = []
        for i, n in enumerate(nodes):
            if i:
                j, edge = place[n.parent], edges[i]
                rest = [down[j][y] + up[j][y] - sent[i][y] for y in (0, 1)]
                down[i] = [_add(rest[0] + edge[0][y], rest[1] + edge[1][y]) for y in (0, 1)]
                top = max(down[i])
                down[i] = [v - top for v in down[i]]
            a, b = (down[i][y] + up[i][y] for y in (0, 1))
            out.append(1 / (1 + math.exp(min(700.0, a - b))))
        return out


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = ordered(root)
    main = dict(zip(nodes, model.marginals(nodes), strict=True))
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    stack: list = [(root, iter(root.parts))]
    while stack:
        n, parts = stack[-1]
        for p in parts:
            if isinstance(p, str):
                if main[n] > 0.5:
                    now.append(p)
                continue
            if p.tag == "br":
                now.append(" ")
            if p in main:
                if p.tag in BLOCK:
                    flush()
                stack.append((p, iter(p.parts)))
                break
        else:
            stack.pop()
            if n.tag in BLOCK:
                flush()
    flush()
    return "\n".join(blocks)


#: What the labelled pages are made of: sentences; words that name what surrounds an article, what holds one, and either.
_SHORT, _MID = "It rained.", "The boats came back at noon, and nobody had seen the storm that the radio spoke of."
_LONG = f"{_MID} Later that week the harbour was full again. {_MID} Few people talked about it! {_MID} {_MID}"
_OUTER = {
    "nav": "nav menu navbar navigation links breadcrumb breadcrumbs crumbs pagination", "header": "header top masthead banner",
    "footer": "footer bottom copyright legal", "aside": "sidebar side rail related recommended widget teaser more", "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion banner",
    "notice": "cookie cookies notice consent popup modal alert warning notification disclaimer banner", "comments": "comments comment discussion responses disqus reply replies",
    "form": "newsletter subscribe signup search login contact", "share": "share social tags follow",
}
_INNER = "content post entry article body main story text page copy prose".split()
_NEUTRAL = "container row col wrapper wrap inner section box block left right center grid cell layout site outer".split()
_ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "dialog", "form": "search"}
PAGES = 600


class _Maker:
    """Labelled pages by a random rule: data-main attributes say where main text begins and ends."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def names(self, words: list[str], most: int = 3) -> str:
        """A class, an id or both of some of the words, or nothing."""
        some = self.r.sample(words, min(len(words), self.r.randint(1, most)))
        return self.r.choice([f" class='{' '.join(some)}'", f" class='{some[0]}'", f" id='{some[0]}'", f" id='{some[0]}' class='{' '.join(some)}'"])

    def any_names(self) -> str:
        """Of any words: as classes of running text they tell next to nothing."""
        return self.names([*" ".join(_OUTER.values()).split(), *_INNER, *_NEUTRAL], 2)

    def sentences(self) -> str:
        return self.r.choice([_SHORT, _MID, _MID, f"{_MID} {_MID}", _LONG, f"{_LONG} <a href='/x'>the storm</a> {_MID}", f"<b>{_MID}</b> {_SHORT}", f"{_MID}<br>{_SHORT}"])

    def block(self) -> str:
        """A block of an article."""
        named = self.any_names() if self.r.random() < 0.15 else ""
        if self.r.random() < 0.75:
            return f"<p{named}>{self.sentences()}</p>"
        return self.r.choice([
            f"<h2{named}>Afterwards</h2>", f"<ul><li>{self.sentences()}</li><li>Nets</li></ul>", f"<blockquote><p>{self.sentences()}</p></blockquote>", f"<ol><li>Oars</li><li>{_SHORT}</li></ol>",
            f"<figure><img src='a.png'><figcaption>{_SHORT}</figcaption></figure>", f"<pre>a  b</pre><p{named}>{_MID} <a href='/y'>More</a></p>", f"<dl><dt>Oar</dt><dd>{_MID}</dd></dl>",
            f"<table><tr><th>Day</th><td>Boats</td></tr><tr><td>Monday</td><td>{_SHORT}</td></tr></table>", f"<div><p>{self.sentences()}</p></div>",
        ])

    def around(self) -> str:
        """Something that is no main text, by its element, by its names, or by both."""
        kind = self.r.choice(list(_OUTER))
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        clear = tag and self.r.random() < 0.6
        tag = tag if clear else self.r.choice(["div", "div", "section", "ul"] if kind in ("nav", "share") else ["div", "div", "section"])
        named = "" if clear and self.r.random() < 0.5 else self.names(_OUTER[kind].split())
        named += f" role='{_ROLES[kind]}'" if kind in _ROLES and self.r.random() < 0.15 else ""
        menu = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in self.r.sample(["Home", "News", "About us", "Sports and more", "Archive", "One"], self.r.randint(2, 6))) + "</ul>"
        talk = "".join(f"<p>{self.sentences()}</p>" for _ in range(self.r.randint(1, 6)))
        inside = {
            "nav": menu[4:-5] if tag == "ul" else self.r.choice([menu, "<a href='/'>Home</a> <a href='/n'>News</a>"]), "header": self.r.choice([f"<h1>The Gazette</h1>{_SHORT}", f"<a href='/'>The Gazette</a>{menu}", "The Gazette"]),
            "footer": self.r.choice([f"<p>&copy; The Gazette. All rights reserved. {_MID}</p><a href='/t'>Terms</a>", "All rights reserved.", f"{_SHORT}{menu}", talk]), "aside": f"<h3>Most read</h3>{self.r.choice([menu, talk, menu + talk])}",
            "ad": self.r.choice([_MID, f"<h2>Boats</h2><p>{_MID}</p><a href='/buy'>Buy now</a>", _SHORT]), "notice": f"<p>We use cookies. {self.r.choice([_MID, _SHORT, _LONG])}</p><button>Accept</button>",
            "comments": f"<h3>2 comments</h3>{talk}<div class='comment reply'><p>{_MID}</p></div>", "share": "<a href='/f'>Share</a> <a href='/g'>Next page</a>",
            "form": f"<p>{_SHORT}</p><label>Your mail</label><input name='m'><select><option>Daily</option></select><textarea>{_SHORT}</textarea><button>Send</button>",
        }[kind]
        return f"<{tag} data-main='0'{named}>{inside}</{tag}>"

    def page(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 30]))]
        title = f"<h1>{r.choice(['The storm', _MID])}</h1>"
        hold = r.choice(["article", "article", "main", "both", "section", "section", "div", "div", "named", "neutral", "nested", "bare", "bare", "bare", "alone"])
        blocks = [r.choice([title, title, f"<header>{title}</header>", f"<header>{title}<p>{_SHORT}</p></header>"]) if hold in ("article", "both") else title, *blocks][r.random() < 0.15 :]
        if r.random() < 0.4 and hold != "bare":
            blocks.insert(r.randrange(len(blocks) + 1), self.around())
        inner, main = "".join(blocks), " data-main='1'"
        some = lambda words: self.names(words) if r.random() < 0.5 else ""
        if hold in ("bare", "alone"):
            held = inner
        elif hold == "both":
            held = f"<main{main}><article{some(_INNER)}>{inner}</article></main>"
        elif hold == "nested":
            held = inner
            for _ in range(r.randint(2, 4)):
                held = f"<div{some(_NEUTRAL)}>{held}</div>"
            held = f"<div{main}{held[4:]}"
        else:
            tag = {"named": r.choice(["div", "section"]), "neutral": "div"}.get(hold, hold)
            held = f"<{tag}{main}{self.names(_INNER) if hold == 'named' else self.names(_NEUTRAL) if hold == 'neutral' else some(_INNER) if hold in ('article', 'main') else ''}>{inner}</{tag}>"
        before, after = ("".join(self.around() for _ in range(r.randint(0, 3))) if hold != "alone" else "" for _ in range(2))
        if hold not in ("bare", "alone") and r.random() < 0.3:  # what surrounds the article lies with it in one element
            return f"<html><head><title>t</title></head><body><div{some(_NEUTRAL)}>{before}{held}{after}</div></body></html>"
        return f"<html><head><title>t</title></head><body{main if hold in ('bare', 'alone') else ''}>{before}{held}{after}</body></html>"


@lru_cache(maxsize=1)
def labelled_pages() -> tuple[str, ...]:
    """PAGES pages by the rule of _Maker: an article of 1 to 30 blocks in any kind of element or in none, with and without
    what surrounds articles, beside and inside it."""
    maker = _Maker(1)
    return tuple(maker.page() for _ in range(PAGES))


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model(list(labelled_pages()))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url, text, n_chars: one row per row.

    Null and empty html, and pages without main text: empty text. The header of an article, with its headline, belongs to it;
    headers of the page do not. An element whose marginal is just 0.5 is not main text. Pages are read whole however long, in
    time linear in their length. White space within a block is one blank; blocks are
    joined by line ends in page order. Unclosed and misnested markup is read as browsers do for the common cases.
    Repeated rows give repeated results; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for b in batches:
            texts = [main_text(x.as_py(), model) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
