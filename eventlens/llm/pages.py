"""Main text of web pages by scoring the tree of elements.

A page becomes a tree, by the tokens of HTML. Paragraphs score for their
length and commas and pass the points to their ancestors, less to each further
one; a container's points are discounted by the share of its text that is
links, and weighed by what its tag, name and class say. The best container is
kept, with those of its siblings that score like it, its other prose and the
text that lies beside it; of equal scores the container that begins first is
best. A short sibling that says what notices say isn't kept. Where the best container lies in an ``article`` or
``main`` element, that element is the container, since an article may be laid
out in sections; further articles beside it are kept too.

Elements that are never part of an article (menus, headers and footers of the
page, asides, forms, scripts, styles, adverts, notices, reader comments) are
taken out before, by tag and by the names in their class, id and role. A name
counts as a whole: ``share-buttons`` says what an element is, and
``post-share-analysis`` does not. Names don't decide alone: an element that
holds the page's best article or main element, or several paragraphs with the
greater part of the page's points and few links, stays and is left to the score. One named
after comments needs a good name as well.

Pages are independent: each is one row in one task, and nothing is shuffled.

Defined results: a null, empty or text-free page gives an empty text; mark-up
that is cut short or not closed ends where the page ends; the slash of ``/>``
says nothing, as in HTML; repeated rows are extracted one by one; other
columns pass through ``extract`` and are ignored by the query, a column named
``main_text`` is replaced; an empty table gives an empty result. Texts are
whole, and elements are treated alike, whatever their length and depth.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

#: A value ends with its quote if it starts with one, else at a blank or ">";
#: quotes anywhere else are characters like others.
_VALUE = r"\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)|</>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|={_VALUE})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*))?)?")
_NAMING = re.compile(r"\b(?:class|id|role|itemprop|aria-hidden|style|hidden)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}

#: What notices say, whatever their elements are called.
NOTICES = re.compile(r"\b(?:(?:we|site|page|website) uses? cookies|cookie (?:policy|settings|consent)|accept (?:all )?cookies|privacy policy|subscribe (?:to|now)|"
                     r"(?:our|the|a) newsletter|sign up (?:for|to|now)|sponsored (?:by|content)|advertisement)\b", re.I)
# Tags by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var img wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 "
               "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an omitted end tag isn't looked for.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}}
#: Elements that other end tags don't close from within.
BARRIERS = {"td", "th", "table", "caption", "template"}
NEVER = set("nav aside footer form script style noscript iframe template textarea title head button select input object "
            "svg canvas video audio dialog menu map xmp".split())
PARAGRAPHS = set("p pre td blockquote li dd figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Siblings of a container that belong with it unless they are links.
SIBLINGS = HEADINGS | set("p blockquote pre ul ol dl figure table tr td th".split())
CONTAINERS = set("article main section div td body blockquote pre".split())
#: Words of a class, id or role; and those that may stand beside them in one name.
BAD_WORDS = set("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted "
                "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist "
                "discussion disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay "
                "newsletter subscribe subscription signup share sharing social related recommended recommendations pager pagination "
                "toolbar widget widgets outbrain taboola skip search login alert complementary contentinfo tags".split())
BESIDE = set("site page post posts entry article blog user reader main top bottom left right first last primary secondary side sticky fixed global "
             "mobile desktop inline box bar area section block list item items link links button buttons icons container wrapper wrap inner outer "
             "holder slot unit row col column panel form thread region group module bottombar google dfp js id".split())
GOOD_WORDS = set("article content entry main post body text story hentry blog page articlebody".split())
COMMENT_WORDS = set("comment comments commentlist discussion disqus reply replies respond".split())
AD_WORDS = set("ad ads advert adverts advertisement sponsored".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "names", "points", "weight", "chars", "linked", "own", "commas", "hidden", "out", "holds", "within", "scored")

    def __init__(self, tag: str, parent: Node | None, names: tuple[frozenset[str], ...] = (), hidden: bool = False) -> None:
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.children: list[Node | str] = []
        self.points = self.weight = 0.0
        self.chars = self.linked = self.own = self.commas = self.scored = 0
        self.out = self.holds = False
        self.within = ""

    @property
    def words(self) -> frozenset[str]:
        return frozenset().union(*self.names)

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 1.0


def _named(rest: str) -> tuple[tuple[frozenset[str], ...], bool]:
    """The names of an element, each as its words, and whether it is hidden."""
    names, hidden = set(), False
    for name, *values in _ATTRIBUTE.findall(rest):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in "".join(value.split()).lower()
        elif name in ("class", "id", "role", "itemprop"):
            names.update(frozenset(_WORDS.findall(_CAMEL.sub(r"\1 \2", n).lower())) for n in value.split())
    return tuple(n for n in names if n), hidden


def parse(page: str) -> list[Node]:
    """The elements of a page in order, the root first; end tags that are left
    out are put in."""
    root = top = Node("body", None)
    nodes, opened = [root], defaultdict(int)
    at = 0

    def close(node: Node) -> Node:
        """Close everything up to and with ``node``."""
        inner = top
        while True:
            opened[inner.tag] -= 1
            if inner is node:
                return node.parent
            inner = inner.parent

    while (found := _TOKEN.search(page, at)) is not None:
        if found.start() > at:
            top.children.append(references.unescape(page[at: found.start()]))
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if found[1]:
            if opened[tag]:
                node, inline = top, tag in INLINE
                while node is not root and node.tag != tag and not (inline and node.tag not in INLINE) and (
                        node.tag not in BARRIERS or tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "template", "caption")):
                    node = node.parent
                if node.tag == tag and node is not root:
                    top = close(node)
            continue
        if tag in CLOSES_P and opened["p"]:
            node = top
            while node.tag in INLINE and node is not root:
                node = node.parent
            if node.tag == "p":
                top = close(node)
        if tag in SAME_CLOSES and any(opened[t] for t in SAME_CLOSES[tag]):
            node = top
            while node is not root and node.tag not in SAME_CLOSES[tag] and node.tag not in SCOPES[tag]:
                node = node.parent
            if node.tag in SAME_CLOSES[tag]:
                top = close(node)
        rest = found[3]
        names, hidden = _named(rest) if rest and _NAMING.search(rest) else ((), False)
        child = Node(tag, top, names, hidden)
        top.children.append(child)
        nodes.append(child)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            opened[tag] += 1
            top = child
    if at < len(page):
        top.children.append(references.unescape(page[at:]))
    return nodes


def _misnamed(node: Node) -> bool:
    """Whether an element's names say that it is no part of an article."""
    if node.tag == "header" or not node.names:
        return False
    if node.tag in ("article", "main"):
        return any(n <= BESIDE | COMMENT_WORDS | AD_WORDS | {"promo"} and n & (COMMENT_WORDS | AD_WORDS | {"promo"}) for n in node.names)
    bad = [n for n in node.names if n & BAD_WORDS and (n <= BAD_WORDS | BESIDE or n & AD_WORDS)]
    if not bad:
        return "header" not in node.within and any("header" in n and n <= BESIDE | {"header"} for n in node.names)
    return not node.words & {"articlebody", "hentry"} or any(n & COMMENT_WORDS for n in bad)


def _measure(nodes: list[Node], names: bool) -> None:
    """Which elements are out, and of the others lengths, links and points."""
    for node in nodes:
        up = node.parent
        # Where an element lies: in a link, and where a header isn't the page's.
        node.within = (up.within if up else "") + ("" if node.tag != "a" or (up and "link" in up.within) else " link")
        if "header" not in node.within and (node.tag in ("article", "main") or node.words & {"content", "entry", "article", "post"}):
            node.within += " header"
        inside = up is not None and "header" in up.within
        node.out = up is not None and (up.out or node.hidden or node.tag in NEVER or (node.tag == "header" and not inside)
                                       or (names and not node.holds and _misnamed(node)))
        texts = [" ".join(c.split()) for c in node.children if isinstance(c, str)] if not node.out else []
        node.chars = node.own = sum(map(len, texts))
        node.commas = sum(t.count(",") for t in texts)
        node.linked = node.chars if "link" in node.within else 0
        node.points, node.weight, node.scored = 0.0, 0.0, 0
    for node in reversed(nodes):
        up = node.parent
        if node.out:
            continue
        if node.tag in PARAGRAPHS or (node.own > 0 and node.tag in CONTAINERS):
            points = 1 + node.commas + min(node.own / 100, 3)
            node.weight += points
            node.scored += 1
            to, share = node if node.tag in CONTAINERS else up, 1.0
            while to is not None and share > 0.1:
                to.points += points * share
                to, share = to.parent, share / 2
        if up is not None:
            up.weight += node.weight
            up.scored += node.scored
            up.chars += node.chars
            up.linked += node.linked
            if node.tag in INLINE:
                up.own += node.own
                up.commas += node.commas


def _spare(nodes: list[Node]) -> None:
    """Mark the elements that stay whatever their names are. The whole page
    has been measured without a look at names."""
    root, best = nodes[0], None
    for node in nodes:
        if node.out:
            continue
        good = not node.words & COMMENT_WORDS or bool(node.words & GOOD_WORDS)
        if 2 * node.weight > root.weight and node.scored > 1 and 3 * node.linked < node.chars and good:
            node.holds = True
        if node.tag in ("article", "main") and node.weight and not _misnamed(node) and (best is None or node.weight > best.weight):
            best = node
    while best is not None:
        best.holds = not best.words & COMMENT_WORDS or bool(best.words & GOOD_WORDS)
        best = best.parent


def _score(node: Node) -> float:
    weight = 25 * bool(node.words & GOOD_WORDS) + (30 if node.tag == "article" else 20 if node.tag == "main" else 0)
    return (node.points + (weight if node.points else 0)) * (1 - node.density)


def _is_prose(text: str) -> bool:
    return len(text) >= 40 or text.endswith((".", "!", "?"))


def _is_notice(node: Node) -> bool:
    """Whether a container beside the article, of a few short blocks and
    without a good name, says what notices of sites say."""
    short = node.chars < 300 and node.scored <= 2 and not node.words & GOOD_WORDS
    return short and bool(NOTICES.search(_text([node])))


def _kept(nodes: list[Node]) -> list[Node | str]:
    """The best container and what lies beside it and belongs with it."""
    best, most = nodes[0], _score(nodes[0]) / 2
    for node in nodes:
        if not node.out and node.tag in CONTAINERS and node.points and _score(node) > most:
            best, most = node, _score(node)
    up, article = best, None
    while up is not None:
        if up.tag == "article" or (up.tag == "main" and article is None):
            article = up
        up = up.parent
    best = article or best
    if best.parent is None:
        return [best]
    page = best.parent.parent is None
    kept: list[Node | str] = []
    for other in best.parent.children:
        if isinstance(other, str):
            take = bool(other.strip()) and (not page or _is_prose(other.strip()))
        elif other.out:
            take = False
        elif other.tag in INLINE:
            take = other.density < 0.25 and not page
        else:
            alike = other.points and _score(other) >= 0.2 * most
            prose = other.tag in (HEADINGS if page and article else SIBLINGS) and other.density < 0.25
            also = article and other.tag == best.tag and other.density < 0.5
            take = other is best or (prose or ((alike or also) and not (other.tag in CONTAINERS and _is_notice(other))))
        if take:
            kept.append(other)
    return kept


def _text(kept: list[Node | str]) -> str:
    out, todo = [], list(reversed(kept))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.out:
            if item.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(item.children))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by one space."""
    if not page:
        return ""
    nodes = parse(page)
    _measure(nodes, names=False)
    _spare(nodes)
    _measure(nodes, names=True)
    return _text(_kept(nodes))


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``main_text`` to every page."""
    return df.withColumn("main_text", _main_text(F.col(html)))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("main_text").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict = {}
