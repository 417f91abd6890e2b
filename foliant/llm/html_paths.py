"""Main text of web pages by consensus container paths per host.

1. Score: each page's containers get the text of the blocks below them, less link text, in full
   from their own blocks and by halves from blocks further down.
2. Vote: containers are named by generalised paths (tags with classes, digits folded, repeated
   elements folded). A Spark aggregation sums votes and scores over (host, path); the path with
   most first places wins its host, ties to the higher score, then to the smaller path.
3. Re-extract: each page's blocks below the winning path, or below the page's own best
   container where the page has no such path or no host.

Menus, headers outside an article, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are left out by tag, role and class wherever they stand. Long links count as text. A class or id counts
by a whole token or by its first or last word. An element left out by class or id alone is kept
after all if it holds the article, or (named by part of a token) most of the page's text without
links, or if nothing else is left. A container is widened to its article or main element, or to
the parents (short of body) whose other blocks are not mainly links.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import cut, small, table

# Attributes as HTML reads them: a quote opens a value only after "=", and one that is never
# closed is a character like others. Every match goes on to the tag's end or the page's, and
# nothing is tried twice, so the scan is linear.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?"
_ATTRS = rf"(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:{_VALUE})?)*+"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|noembed|noframes|xmp)(?=[\s/>]){_ATTRS}(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?)?")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins del kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
_CONTAINER = frozenset("article main section div td body center table blockquote".split())
#: Elements that an implied end tag does not reach through.
_SCOPE = _CONTAINER | frozenset("ul ol dl".split())
_SKIP_TAG = frozenset("nav footer aside menu dialog head select button svg canvas audio video object math".split())
_SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SKIP_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside widget footer masthead comment comments commentlist disqus respond replies "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay form login search toolbar pagination pager".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOT = frozenset("no not has have with without is long".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A link of more characters is text, not a way to another page; longer paths are kept by their digest.
LINK_CHARS, PATH_CHARS = 200, 512


class _Node:
    __slots__ = ("tag", "name", "parent", "up", "skip", "link", "size", "own", "path", "inside", "part", "named", "article", "text", "body", "first", "last")

    def __init__(self, tag, name, parent, skip, number, by_name=0, wanted=None):
        self.tag, self.name, self.parent, self.skip = tag, name, parent, skip
        self.first = self.last = number
        self.own = self.text = self.body = 0.0
        self.size = 0
        container = tag in _CONTAINER
        if parent is None:
            self.up = self.link = self.named = self.article = None
            self.path, self.inside = "", False
        else:
            self.up = self if container else parent.up
            self.path = _below(parent.path, name) if container else parent.path
            self.inside = parent.inside or (container and self.path == wanted)
            self.link = self if tag == "a" else parent.link
            # by_name: 1 left out by part of a class token, 2 by a whole one; named: nearest such element, itself included
            self.named = self if by_name and tag not in ("body", "html", "article", "main") else parent.named
            self.article = self if tag in ("article", "main") and not by_name else parent.article
        self.part = by_name == 1


def _below(path: str, name: str) -> str:
    """The path of a container below another; a name that follows itself is folded."""
    if path == name or path.endswith(">" + name):
        return path
    path = f"{path}>{name}" if path else name
    return path if len(path) <= PATH_CHARS else "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()


def _by_name(value: str) -> int:
    """Whether a class or id names no part of an article: 2 by a whole token, 1 by the first or last word of one, else 0."""
    most = 0
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if len(words) == 1 and words[0] in _SKIP_WORD:
            return 2
        if len(words) > 1 and not _NOT.intersection(words) and (words[0] in _SKIP_WORD or words[-1] in _SKIP_WORD):
            most = 1
    return most


def _describe(tag: str, attrs: str, in_article: bool) -> tuple[str, bool, int]:
    """(generalised name, whether the element is no part of an article by tag or role, whether by class or id)."""
    skip = tag in _SKIP_TAG or (tag == "header" and not in_article)
    # a form may be wrapped round a whole page: it goes like an element named by part of a token
    name, by_name, seen = tag, int(tag == "form"), set()
    if attrs and not attrs.isspace():
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in seen:
                continue
            seen.add(key)
            if key in ("class", "id"):
                by_name = max(by_name, _by_name(value))
                if key == "class" and value:
                    name = tag + "." + ".".join(sorted({re.sub(r"\d+", "0", x.lower()) for x in value.split()}))
            elif key == "role":
                skip = skip or value.lower() in _SKIP_ROLE
            elif key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true":
                skip = True
    return name, skip, by_name


Block = tuple[_Node, str, int]


def _left(found: list[Block]) -> list[Block]:
    """The blocks that are not in elements left out by class or id."""
    total = outside = 0.0
    named: dict[int, _Node] = {}
    for node, text, linked in found:
        gain = len(text) - 2.0 * linked
        total += len(text) - linked
        if node.named is not None:
            node.named.text += len(text) - linked
            named[node.named.first] = node.named
        if node.article is not None:
            holder = node.article.named
            if holder is None:
                outside += gain
            else:
                holder.body += gain
                named[holder.first] = holder
    if not named:
        return found
    waiting = list(named.values())
    while waiting:
        over = waiting.pop().parent.named
        if over is not None and over.first not in named:
            named[over.first] = over
            waiting.append(over)
    # sums go up from the last named element to the first, decisions down
    for number in sorted(named, reverse=True):
        node, over = named[number], named[number].parent.named
        if over is not None:
            over.text += node.text
            over.body += node.body
    gone: dict[int, bool] = {}
    for number in sorted(named):
        node, over = named[number], named[number].parent.named
        most = 2 * node.text > total
        stays = node.body > max(0.0, outside) and (node.part or most) or node.part and most
        gone[number] = not stays or (over is not None and gone[over.first])
    return [f for f in found if f[0].named is None or not gone[f[0].named.first]] or found


def blocks(page: str, wanted: str | None = None) -> list[Block]:
    """(element, text, characters of link text) of each block outside skipped elements, in page order.

    Elements below a container of the path ``wanted`` are marked as inside. One pass; each
    element is opened and closed once, so time is linear in the page whatever its markup.
    """
    out: list[tuple[_Node, str, list]] = []
    node = _Node("#root", "#root", None, False, 0)
    count = articles = 0
    pieces: list[str] = []
    links: list[tuple[_Node, int]] = []
    owner = node
    opened: dict[str, int] = {}
    # of each open scope the elements that are open in it, by tag, and its own element
    scopes: list[dict[str, int]] = [{}]
    roots = [node]

    def flush():
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((owner, text, links))
            pieces, links = [], []

    def close(until: _Node):
        nonlocal node, articles
        while True:
            done = node
            done.last = count
            opened[done.tag] -= 1
            articles -= done.tag in ("article", "main")
            if done.tag in _SCOPE:
                scopes.pop()
                roots.pop()
            else:
                scopes[-1][done.tag] -= 1
            node = done.parent
            if done is until:
                return

    def nearest(tags) -> _Node:
        target = node
        while target.tag not in tags:
            target = target.parent
        return target

    def text_at(raw: str):
        nonlocal owner
        if node.skip or not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        if not pieces:
            if value.isspace():
                return
            owner = node
        pieces.append(value)
        if node.link is not None:
            node.link.size += len(value)
            links.append((node.link, len(value)))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text_at(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if m["end"]:
            if (scopes[-1] if inline else opened).get(tag):
                target = nearest((tag,))
                if not inline or node.named is not target.parent.named:
                    flush()
                close(target)
            elif tag == "p":
                flush()
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if not inline:
            flush()
            closes = _CLOSES.get(tag, ())
            scope = scopes[-1]
            if scope.get("p") or any(scope.get(c) for c in closes):
                close(nearest({"p", *closes}))
            elif closes and len(scopes) > 1 and roots[-1].tag in closes:
                close(roots[-1])
        name, skip, by_name = _describe(tag, m["attrs"], articles > 0)
        if skip or by_name:
            flush()
        count += 1
        node = _Node(tag, name, node, node.skip or skip, count, by_name, wanted)
        opened[tag] = opened.get(tag, 0) + 1
        articles += tag in ("article", "main")
        if tag in _SCOPE:
            scopes.append({})
            roots.append(node)
        else:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
    if at < len(page):
        text_at(page[at:])
    flush()
    while node.parent is not None:
        node.last = count
        node = node.parent
    return _left([(n, text, sum(k for link, k in linked if link.size <= LINK_CHARS)) for n, text, linked in out])


def scores(found: list[Block]) -> list[_Node]:
    """Containers with their score in ``own``, in page order of first text."""
    seen: dict[int, _Node] = {}
    for node, text, linked in found:
        gain = (len(text) - 2 * linked) * 1.0
        up = node.up
        while up is not None and gain:
            seen.setdefault(up.first, up)
            up.own += gain * (1.5 if up.tag in ("article", "main") else 1.0)
            gain = gain / 2 if abs(gain) > 1 else 0
            up = up.parent.up
    return list(seen.values())


def _best(nodes: list[_Node], found: list[Block]) -> _Node | None:
    """The container of the highest score, widened to its article or to parents with more text."""
    best = max(nodes, key=lambda n: n.own, default=None)
    if best is None:
        return None
    chain, up = [], best
    while up is not None and up.tag not in ("body", "html", "#root"):
        if up.tag in ("article", "main"):
            return up
        chain.append(up)
        up = up.parent
    # the elements of the chain lie in each other: the first whose range reaches a block holds it
    gains = [0.0] * len(chain)
    starts = [-n.first for n in chain]
    ends = [n.last for n in chain]
    for node, text, linked in found:
        i = max(bisect_left(starts, -node.first), bisect_left(ends, node.first))
        if i < len(chain):
            gains[i] += len(text) - 2 * linked
    others = 0.0
    for node, gain in zip(chain[1:], gains[1:]):
        others += gain
        if node.tag in _CONTAINER:
            if others < 0:
                break
            if others > 0:
                best, others = node, 0.0
    return best


def main_text(page: str, path: str | None) -> str:
    """Text of the blocks below ``path``, or below the page's own best container."""
    found = blocks(page, path)
    inside = [text for node, text, _ in found if node.inside]
    if inside:
        return " ".join(inside)
    best = _best(scores(found), found)
    return " ".join(text for node, text, _ in found if best is None or best.first <= node.first <= best.last)


def _votes(batches):
    for batch in batches:
        host, path, score, first = [], [], [], []
        for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = blocks(page)
            nodes = scores(found)
            best = _best(nodes, found)
            by_path: dict[str, float] = {}
            for n in nodes:
                by_path[n.path] = by_path.get(n.path, 0.0) + n.own
            top = best.path if best is not None else None
            if top is not None:
                by_path.setdefault(top, best.own)
            for p, s in by_path.items():
                host.append(h)
                path.append(p)
                score.append(s)
                first.append(int(p == top))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64()), pa.array(first, pa.int64())], ["host", "path", "score", "first"])


def _extract(batches):
    for batch in batches:
        text = [main_text(page, path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning container path."""
    votes = pages.where("host <> ''").select("host", "html").mapInArrow(_votes, "host string, path string, score double, first long")
    sums = votes.groupBy("host", "path").agg(F.sum("first").alias("first"), F.sum(F.round("score")).alias("score")).where("first > 0")
    return sums.groupBy("host").agg(F.max_by("path", F.struct("first", "score", F.reverse("path"))).alias("path"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    pages has ``page_id``, ``url`` and ``html``; other columns are not read. Null html is empty
    text. A null url, or one without ``://``, has no host: such a page is judged by itself. A
    null page_id is kept, and rows that repeat are extracted each. Empty text where a page has
    none. An empty table gives an empty one.
    """
    host = F.lower(F.regexp_extract("url", r"^[^/?#]*?://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    winners = small(cut(host_paths(rows), "host-paths"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
SQL: dict[str, str] = {}
