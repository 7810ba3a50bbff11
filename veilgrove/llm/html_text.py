"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the share of the page's running text that
they hold, links counting against it, deeper containers of equal share winning.
The scores are votes for the containers' generalised paths (tags and first
classes from the root, digits removed), added up per host in Spark; the path
with most votes wins the host.  Pages are then extracted from the elements on
the winning path, and from their own best container where they have none.

Blocks are the runs of text between block-level tags.  Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined
by one newline in page order.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by tag, role or
the words of their class and id: a name with such a word in it counts, whatever
other words it has, unless a word of having or lacking stands before (as in
``has-sidebar``) or another name of the element is all words of content.  Of
headers, headings in the article stay.

Reading is linear in a page.  A tag's quotes are followed to their ends; where
one never ends, tags up to there end at their first angle bracket instead.  Open
elements are found by their tag, and what blocks and containers need to know of
the elements above is kept in each.

Defined cases: a null page is the empty one and gives the empty text; a null or
odd URL belongs to the host ''; of paths with equal votes the first in order
wins; repeated rows give repeated rows and vote as often; broken markup is read
as far as it goes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import bounded_batches, cut, ddl

# -- markup -------------------------------------------------------------------------------
_RAW = frozenset("script style noscript template textarea svg iframe title select math object".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in _RAW}
_NAME = re.compile(r"(/)?([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)


def marks(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, whether it closes, attributes) of the markup of a page in order; other markup has no tag.

    Elements of raw text come as one mark without a tag.
    """
    at, lenient, size = 0, 0, len(page)
    gone: set[str] = set()  # characters that do not come again

    def find(what: str, start: int) -> int:
        if what in gone:
            return -1
        k = page.find(what, start)
        if k < 0:
            gone.add(what)
        return k

    while (at := find("<", at)) >= 0:
        if page.startswith("<!--", at):
            k = find("-->", at + 4)
            end = size if k < 0 else k + 3
            yield at, end, None, False, ""
            at = end
            continue
        m = _NAME.match(page, at + 1)
        if m is None:
            k = find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") else -1
            if k >= 0:
                yield at, k + 1, None, False, ""
            at = max(at + 1, k + 1)
            continue
        k = m.end()
        if at >= lenient:
            while (stop := _STOP.search(page, k)) is not None and stop[0] != ">":
                close = find(stop[0], stop.end())
                if close < 0:
                    lenient, stop = stop.end(), None
                    break
                k = close + 1
            end = stop.end() if stop is not None else find(">", m.end()) + 1
        else:
            end = find(">", m.end()) + 1
        if not end:
            return
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            shut = _RAW_END[tag].search(page, end)
            end = shut.end() if shut else size
            yield at, end, None, False, ""
        else:
            yield at, end, tag, bool(m[1]), page[m.end() : end - 1]
        at = end


#: Tags that hold no content, tags that end a block, and which open tags a new tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head", ("html",)),
}
_CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _CLOSES.items()}
_P_ENDERS = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}

# -- what is not article ----------------------------------------------------------------------
#: Tags, and words of classes and ids, of parts around an article.
_OUT_TAGS = frozenset("head nav aside footer header form button dialog menu label input fieldset".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer header masthead banner ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social related recommended recommendations "
    "pagination pager widget toolbar comment comments commentlist discussion respond replies disqus skip contentinfo complementary".split()
)
_IN_WORDS = frozenset("article content main post entry story page wrapper container layout body text".split())
_HAVING = frozenset("has have with no without hide hidden".split())
_HEADER_WORDS = frozenset(("header", "masthead"))
_CONTAINERS = frozenset("article main section div td body center".split())
_LIKE_ARTICLE = {"article": 1.5, "main": 1.3}


#: Characters of a path beyond which its beginning is told by a hash.
_LONG_PATH = 400


def _names_out(names: list[list[str]]) -> set[str]:
    """The words that count against an element, from its names in words; none if a name is all words of content."""
    if any(words and set(words) <= _IN_WORDS for words in names):
        return set()
    return {w for words in names for before, w in zip(["", *words], words, strict=False) if w in _OUT_WORDS and before not in _HAVING}


class _Node:
    __slots__ = ("tag", "step", "path", "up", "out", "header", "heading", "link", "inside", "depth", "block", "worth")

    def __init__(self, tag: str, attr: str, up: _Node | None) -> None:
        self.tag, self.up, self.worth = tag, up, 0.0
        names, first, role = [], "", ""
        if attr:
            for m in _NAMED.finditer(attr):
                v = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "role":
                    role = v
                    continue
                for k, name in enumerate(v.split()):
                    if k == 0 and not first and m[1].lower() == "class":
                        first = name
                    names.append([w for w in re.split(r"[^a-z]+", name) if w])
        self.step = f"{tag}.{re.sub(r'[0-9]+', '', first)}" if first else tag
        #: Nested equal steps are one step of the generalised path.
        self.path = self.step if up is None else up.path if up.step == self.step else f"{up.path}>{self.step}"
        if len(self.path) > _LONG_PATH:
            self.path = f"#{hashlib.md5(self.path.encode('utf-8', 'replace')).hexdigest()}"
        self.depth = up.depth + 1 if up else 0
        self.link = tag == "a" or bool(up and up.link)
        self.inside = tag in ("article", "main") or bool(up and up.inside)
        self.out = bool(up and up.out)
        self.header = bool(up and up.header)
        #: The nearest block-level element, this one included.
        self.block: _Node = self if tag in _BLOCK or up is None else up.block
        if not self.out:
            against = _names_out(names) if tag not in ("html", "body", "article", "main") else set()
            roles = tag not in ("html", "body", "article", "main") and role in ("navigation", "banner", "contentinfo", "complementary", "search", "form")
            if tag in _OUT_TAGS or against or roles:
                if self.inside and (tag == "header" or against and against <= _HEADER_WORDS) and not roles:
                    self.header = self.header or tag not in _HEADINGS
                elif not (tag in _HEADINGS and against <= _HEADER_WORDS):
                    self.out = True
        #: Whether this is in a heading, with nothing but parts of a header between.
        self.heading = tag in _HEADINGS or bool(self.header and up and up.heading)


def parse(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """Blocks of a page that are not left out: (innermost block-level element, text, characters in links); and all elements, outer ones first."""
    root = _Node("html", "", None)
    stack, blocks, buf, nodes = [root], [], [], [root]
    places: dict[str, list[int]] = {"html": [0]}
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                owner = stack[-1].block
                if not owner.header or owner.heading:
                    blocks.append((owner, text, linked))
        linked = 0

    def last(*tags: str) -> int:
        """Place in the stack of the innermost open element of these tags; 0 if there is none but the root."""
        return max([0, *(own[-1] for t in tags if (own := places.get(t)))])

    def shut(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    for start, end, tag, closes, attr in [*marks(page), (len(page), len(page), None, False, "")]:
        top = stack[-1]
        if start > at and not top.out:
            piece = page[at:start]
            if "&" in piece:
                piece = html.unescape(piece)
            buf.append(piece)
            if top.link:
                linked += len(piece.strip())
        at = end
        if tag is None:
            continue
        if closes:
            k = last(tag)
            if k:
                if tag in _BLOCK or any(x.tag in _BLOCK for x in stack[k:]):
                    flush()
                shut(k)
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag == "html":
            continue
        if tag in _BLOCK:
            flush()
            if tag in _P_ENDERS:
                k = last("p")
                if k and last("td", "th", "button", "table") < k:
                    shut(k)
        if tag in _CLOSES:
            ends, stop = _CLOSES[tag]
            k = last(*ends)
            if k > last(*stop):
                flush()
                shut(k)
        if tag not in _VOID and not (tag == "body" and places.get("body")):
            places.setdefault(tag, []).append(len(stack))
            stack.append(_Node(tag, attr, stack[-1]))
            nodes.append(stack[-1])
    flush()
    return blocks, nodes


# -- scores and votes ----------------------------------------------------------------------------
def containers(blocks: list[tuple[_Node, str, int]], nodes: list[_Node]) -> list[tuple[float, _Node]]:
    """Score of each container: its share of the running text, better for deeper ones and for article-like tags."""
    total = 0.0
    for owner, text, linked in blocks:
        worth = max(0, len(text) - 2 * linked)
        owner.worth += worth
        total += worth
    for x in reversed(nodes):  # inner ones first
        if x.up is not None:
            x.up.worth += x.worth
    held = [x for x in nodes if x.tag in _CONTAINERS and x.worth]
    return [(x.worth / total * _LIKE_ARTICLE.get(x.tag, 1.0) * (1 + 0.02 * min(x.depth, 20)), x) for x in held] if total else []


def votes(page: str) -> dict[str, float]:
    """A page's score for each path among its containers; elements on one path add up."""
    out: dict[str, float] = {}
    for score, node in containers(*parse(page)):
        if node.up is None or node.up.path != node.path:
            out[node.path] = out.get(node.path, 0.0) + score
    return out


def extract(page: str, path: str | None) -> str:
    """Text of the elements on ``path``, or of the page's own best container if there are none."""
    blocks, nodes = parse(page)
    if not blocks:
        return ""

    def under(chosen: Callable[[_Node], bool]) -> list[str]:
        inside: set[_Node] = set()
        for x in nodes:  # outer ones first
            if x.up in inside or chosen(x):
                inside.add(x)
        return [text for owner, text, _ in blocks if owner in inside]

    kept = under(lambda x: x.tag in _CONTAINERS and x.path == path) if path is not None else []
    if not kept:
        scored = containers(blocks, nodes)
        best = max(scored, key=lambda x: x[0])[1] if scored else nodes[0]
        kept = under(lambda x: x is best)
    return "\n".join(kept)


# -- frames ----------------------------------------------------------------------------------------
#: Winning paths up to this number are broadcast; more are joined by a shuffle on the host.
BROADCAST_HOSTS = 20_000


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    return pages.withColumn("_host", F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """_host, _path: the path with most votes; votes are added up before anything is moved."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], float] = {}
            for host, page in zip(b.column("_host").to_pylist(), b.column("_html").to_pylist(), strict=True):
                for path, score in votes(page).items():
                    total[host, path] = total.get((host, path), 0.0) + round(score, 6)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([round(v * 1e6) for v in total.values()], pa.int64())], names=["_host", "_path", "votes"])

    bounded_batches(pages.sparkSession)
    src = with_host(pages, url_col).select("_host", F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    tally = src.mapInArrow(vote, "_host string, _path string, votes bigint").groupBy("_host", "_path").agg(F.sum("votes").alias("votes"))
    return tally.groupBy("_host").agg(F.min(F.struct(-F.col("votes"), "_path"))["_path"].alias("_path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text (empty if none), n_chars (its code points)."""
    won = cut(host_paths(pages, url_col, html_col))
    src = with_host(pages.select(id_col, url_col, html_col), url_col).select(id_col, url_col, "_host", F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    if won.count() <= BROADCAST_HOSTS:
        won = F.broadcast(won)
    joined = src.join(won, "_host", "left").select(id_col, url_col, "_html", "_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(page, path) for page, path in zip(b.column("_html").to_pylist(), b.column("_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, f"{ddl(pages, id_col, url_col)}, text string, n_chars bigint")
