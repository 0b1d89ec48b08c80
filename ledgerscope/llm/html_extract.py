"""Main text of web pages by composite text density.

A tolerant tokenizer builds a small tree of each page: void and raw-text elements, implied end tags and cut-off pages
are dealt with. Scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and comments are taken
out by element, role or the words of their class and id; what is out by words or as a form stays if it holds the article, or
most of the body's text beside links, and no article of the page is elsewhere. For every other node the density is

    C / T * log(C / LC * T / LT) / log(ln(C * LC / NC + LC_body * C / C_body + e))

with characters C, tags T, link characters LC, other characters NC and link tags LT below it (0 counts as 1): characters
per tag, less where links hold them. The node whose children have the greatest sum of densities holds the main
text. The least density on the way from it to the body is the threshold; next to that way, blocks that reach the threshold or hold
a sentence or the headline are added, and so are bare sentences and headings. Nothing inside the text is left out for its links, except a list
of nothing but links before all other text of a page without an article. Words of a class or an id count for blocks only. What
they say is certain if the last word that matters is one of them ("cookie-notice"); else ("search-strategy") the
element stays in the main text, unless it is a list of links or a form.

Text of a block is joined with single spaces, blocks in page order with line breaks. Defined results: null or empty
html, and pages without text, give an empty string; null bytes and broken markup do no harm; nesting of any depth
is walked without recursion; pages are read one by one, so repeated rows get equal texts. An empty table
gives an empty table. Input columns named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import table, whole_text, without

RESULTS = ("text", "n_chars")

#: Fixed values of the markup language: elements without content, with raw content, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead
    tr ul caption""".split()
)
#: An open element that an arriving one ends, unless one of the elements of the third set is in between.
_P_ENDS = BLOCKS - {"body", "html", "head", "tbody", "thead", "tfoot", "tr", "caption", "li", "dd", "dt", "legend", "summary"}
IMPLIED = {
    **{tag: (frozenset({"p"}), frozenset({"button", "table", "td", "th", "caption", "object"})) for tag in _P_ENDS},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})),
}

#: What can stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())

HEADINGS_AND_P = frozenset("h1 h2 h3 h4 h5 h6 p".split())

#: What never is main text: by element, role, and word of a class or an id.
DROPPED = frozenset(
    """head nav footer aside form script style noscript template iframe object embed svg canvas audio video select
    button textarea input dialog menu search datalist title""".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROPPED_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion
    banner banners cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup login
    sidebar sidebars sidenav aside menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer foot masthead topbar
    comment comments commentlist disqus respond reply replies discussion share sharing social related recommended popup modal
    overlay toolbar pager pagination search searchbox skip widget widgets copyright disclaimer notification notifications
    announcement announcements responses""".split()
)
#: Class names that tell a state of the page, not what an element is: by their first or last word.
STATE_FIRST, STATE_LAST = frozenset("has no with".split()), frozenset("open fixed".split())
#: Words that an id of a section of comments or links may have besides; with any other the id is an anchor.
COMPANIONS = frozenset("area articles bar block box container form items links list posts section stories wrap wrapper".split())
#: Words that a class may end in without telling what an element is.
TRAILING = COMPANIONS | frozenset(
    "item title heading header count thread feed tree root app embed holder inner outer content body text main top bottom left right col column row".split()
)
#: Controls that make an element a form.
CONTROLS = frozenset("input select textarea button form".split())
_SENTENCE = re.compile(r"""[.!?:;…。！？]["')\]»”’]*$""")
#: A block beside the main text without a sentence or headline needs so many characters, and the density.
LEAST_CHARS = 80
#: Words beside "header" that tell the header of an article from that of the page.
ARTICLE_WORDS = frozenset("article post entry content story".split())
_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/>"']+)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    """An element with its children (nodes and strings), and the counts of its subtree."""

    __slots__ = ("tag", "parent", "items", "dropped", "doubtful", "weak", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.doubtful = False  # dropped by words or as a form: what it holds decides
        self.weak = False  # dropped by words that need not mean it: stays inside the main text
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _tokens(tag: str, name: str, value: str, parent: Node) -> list[list[str]]:
    """The words of each class or id that tell what an element is."""
    if name == "id" and tag in HEADINGS_AND_P:
        return []
    tokens = []
    for token in value.split():
        own = [w.lower() for w in _WORDS.findall(token)]
        if own and own[0] not in STATE_FIRST and (len(own) == 1 or own[-1] not in STATE_LAST):
            tokens.append(own)
    if name == "id" and tag == "section":
        words = {w for t in tokens for w in t}
        anchor = words == {"discussion"} and _in_article(parent)
        if anchor or not words <= DROPPED_WORDS | COMPANIONS:
            return []
    return tokens


def _certain(token: list[str]) -> bool:
    """Whether the last word that matters is one of boilerplate."""
    while len(token) > 1 and token[-1] not in DROPPED_WORDS and (token[-1] in TRAILING or token[-1].isdigit()):
        token = token[:-1]
    return token[-1] in DROPPED_WORDS


def _boilerplate(tag: str, attributes: str, parent: Node) -> str:
    """Whether an element is "in" or "out" by its kind; "doubtful" if what it holds decides, "weak" if also where it is."""
    if tag in DROPPED:
        return "doubtful" if tag == "form" else "out"
    if tag == "header" and not _in_article(parent):
        return "out"
    if not attributes.strip() or tag in ("body", "html", "main", "article"):
        return "in"
    tokens: list[list[str]] = []
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            tokens += _tokens(tag, name, value, parent) if tag in BLOCKS else []
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "out"
        elif name == "style" and "display:none" in value.lower().replace(" ", ""):
            return "out"
        elif name == "role" and value.lower() in DROPPED_ROLES:
            return "out"
    words = {w for t in tokens for w in t}
    if "header" in words and words.isdisjoint(ARTICLE_WORDS) and not _in_article(parent):
        return "doubtful"
    if words.isdisjoint(DROPPED_WORDS):
        return "in"
    return "doubtful" if any(map(_certain, tokens)) else "weak"


def _in_article(node: Node | None) -> bool:
    """Whether a header here is that of an article, which has its headline, and not of the page."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def parse(page: str) -> Node:
    """The tree of a page."""
    root = here = Node("", None)
    at, find = 0, _TOKEN.search
    opened: Counter[str] = Counter()

    def close(node: Node, upto: Node) -> Node:
        """Close elements up to and including one; what is around it."""
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        opened[upto.tag] -= 1
        return upto.parent

    def put(text: str) -> None:
        """Add text; in a head it ends the head."""
        nonlocal here, content
        solid = bool(text.strip(" \t\n\r\f\v"))
        if solid and here.tag == "head":
            here = close(here, here)
        content = content or (solid and not opened["template"])
        here.items.append(text)

    content = False  # of a body, with or without its tag
    while (m := find(page, at)) is not None:
        if m.start() > at:
            put(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None or not m[4]:  # a comment, a declaration, or a tag that the page ends in
            continue
        tag = m[2].lower()
        if m[1]:
            # What comes after the end of the body still belongs to it.
            if opened[tag] and tag not in ("body", "html"):
                up = here
                while up.tag != tag:
                    up = up.parent
                here = close(here, up)
            continue
        if tag not in IN_HEAD and not opened["template"]:
            if opened["head"]:
                up = here
                while up.tag != "head":
                    up = up.parent
                here = close(here, up)
            if tag == "body" and (content or opened["body"]):
                continue
            content = content or tag != "body"
        elif tag == "html" and opened["html"]:
            continue
        ends, stops = IMPLIED.get(tag, ((), ()))
        if any(opened[t] for t in ends):
            up, last = here, None
            while up is not root and up.tag not in stops:
                if up.tag in ends:
                    last = up
                    if tag != "tr":
                        break
                up = up.parent
            if last is not None:
                here = close(here, last)
        out = _boilerplate(tag, m[3], here)
        node = Node(tag, here, out != "in")
        node.doubtful, node.weak = out in ("doubtful", "weak"), out == "weak"
        here.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            node.dropped, node.doubtful, node.weak = True, False, False
        elif tag not in VOID:
            opened[tag] += 1
            here = node
    if at < len(page):
        put(entities.unescape(page[at:]))
    return root


def _hold(body: Node) -> None:
    """Take back in what is out by words or as a form, but holds the article or most of the body's text beside links."""
    nodes, stack = [], [(body, False)]
    while stack:
        node, link = stack.pop()
        nodes.append((node, link or node.tag == "a"))
        stack.extend((c, nodes[-1][1]) for c in node.items if isinstance(c, Node) and (c.doubtful or not c.dropped))
    if not any(n.doubtful for n, _ in nodes):
        return
    text: dict[Node, int] = {}
    articles: dict[Node, int] = {}  # so many articles below
    for node, link in reversed(nodes):
        below = [c for c in node.items if isinstance(c, Node) and c in text]
        own = 0 if link else sum(len(_SPACE.sub(" ", c.strip(" \t\n\r\f\v"))) for c in node.items if isinstance(c, str))
        text[node] = own + sum(text[c] for c in below)
        articles[node] = sum(articles[c] for c in below) + (node.tag in ("article", "main") and text[node] > 0)
    # An article that no doubtful element is around is the page's own, and those in doubtful ones are comments and the like.
    firm = _firm(body, text)
    around: dict[Node, int] = {}  # so many of the page's own articles are around
    for node, _ in nodes:  # parents first
        up = node.parent
        around[node] = around[up] + (up in firm) if node is not body else 0
        if node.doubtful and len(firm) == around[node] and (articles[node] or 2 * text[node] > text[body]):
            node.dropped = node.doubtful = False
            firm |= _firm(node, text)


def _firm(top: Node, text: dict[Node, int]) -> set[Node]:
    """The articles with text in an element that stays, without those in doubtful ones."""
    found, stack = set(), [top]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main") and text[node]:
            found.add(node)
        stack.extend(c for c in node.items if isinstance(c, Node) and c in text and not c.doubtful)
    return found


def _ordered(root: Node) -> list[Node]:
    """All nodes that are not out, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.items) if isinstance(c, Node) and not c.dropped)
    return out


def _count(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        for c in node.items:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c.strip(" \t\n\r\f\v")))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += 1 + c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars


def _weigh(nodes: list[Node], body: Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        if node.chars:
            tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            other = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / other * node.link_chars + share * node.chars + math.e)
            inner = max(node.chars / links * tags / link_tags, 1.0)
            node.density = node.chars / tags * math.log(inner) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else 0.0
            if base <= 1.0:
                node.density = node.chars / tags * math.log(inner)
        node.total = sum(c.density for c in node.items if isinstance(c, Node) and not c.dropped)


def _link_list(node: Node) -> bool:
    return node.link_tags > 1 and 2 * node.link_chars > node.chars


def _stays(node: Node) -> bool:
    """Whether an element that only may be boilerplate is text: no list of links and no form."""
    chars = links = tags = 0
    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        here, link = stack.pop()
        if here.tag in CONTROLS:
            return False
        tags += here.tag == "a"
        for c in here.items:
            if isinstance(c, str):
                n = len(_SPACE.sub(" ", c.strip(" \t\n\r\f\v")))
                chars, links = chars + n, links + n * (link or here.tag == "a")
            elif c.weak or not c.dropped or c.tag in CONTROLS:
                stack.append((c, link or here.tag == "a"))
    return not (tags > 1 and 2 * links > chars)


def _menu(node: Node) -> bool:
    """Whether a list is nothing but links."""
    return node.tag in ("ul", "ol", "div") and node.link_tags > 1 and node.link_chars == node.chars


def _blocks(top: Node) -> list[str]:
    """The blocks of a subtree, in order."""
    out: list[str] = []
    run: list[str] = []
    article = top.tag in ("article", "main")

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        elif item.dropped and not (item.weak and _stays(item)):
            continue
        elif not (article or out) and item is not top and _menu(item):
            continue
        elif item.tag in ("br", "td", "th"):
            run.append(" ")
            stack.extend(reversed(item.items))
        else:
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(item.items))
    end()
    return out


def _beside(items: list[Node | str], threshold: float) -> list[str]:
    """What belongs to the main text of the items before or after it."""
    out: list[str] = []
    run = Node("", None)

    def end() -> None:
        nonlocal run
        for text in _blocks(run):
            if _SENTENCE.search(text):
                out.append(text)
        run = Node("", None)

    for item in items:
        if isinstance(item, str) or (item.tag not in BLOCKS and not item.dropped):
            run.items.append(item)
            continue
        end()
        if item.dropped or not item.chars or _link_list(item) or _menu(item):
            continue
        texts = _blocks(item)
        dense = item.density >= threshold > 0 and item.chars >= LEAST_CHARS
        if dense or any(map(_SENTENCE.search, texts)) or any(n.tag == "h1" for n in _ordered(item)):
            out.extend(texts)
    end()
    return out


def main_text(page: str) -> str:
    """The main text of one page."""
    root = parse(page)
    nodes = _ordered(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    _hold(body)
    nodes = _ordered(body)
    _count(nodes)
    if not body.chars:
        return ""
    _weigh(nodes, body)
    best = max(nodes, key=lambda n: n.total)
    # Inline elements and parts of an article stand for the block, or the article, that they are in.
    while best is not body and best.tag not in BLOCKS:
        best = best.parent
    up = best
    while up is not body:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    before: list[list[str]] = []
    after: list[list[str]] = []
    if best.tag not in ("article", "main"):
        way, up = [best], best
        while up is not body:
            up = up.parent
            way.append(up)
        threshold = min(n.density for n in way)
        for child, around in zip(way, way[1:], strict=False):
            place = next(i for i, c in enumerate(around.items) if c is child)
            before.insert(0, _beside(around.items[:place], threshold))
            after.append(_beside(around.items[place + 1 :], threshold))
    return "\n".join(t for part in (*before, _blocks(best), *after) for t in part)


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows with ``text`` and ``n_chars``, its code points."""
    found = without(pages.withColumn("_he_text", _main_texts(whole_text(html_col))), *RESULTS)
    found = found.withColumnRenamed("_he_text", "text")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
