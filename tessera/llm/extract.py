"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each a leaf of a tree of tag paths; a step of a path is a tag with its class names, which tell
paths apart and have no meaning of their own. Elements that by HTML's own rules are no content (FURNITURE, ROLES, hidden
ones, articles inside articles, headers outside them) go first. Per path, characters, punctuation and link text are summed
over its blocks: the ratios are characters and marks for each block, links counting against them. They are smoothed by the
mean of the containers that the path occurs in (a block's container is the nearest element that isn't one of running text),
fused as a geometric mean with those containers' share of the page's text, and every path that reaches SHARE of the best is
content; its blocks are kept whole, in order. Text in an `article` or `main`, which name the content by HTML's rules, counts ARTICLE times as much.

Containers alike that hold little text each, beside a path of more and longer blocks, are readers' remarks: such a path has
the share of one of them, not of all. Nothing here reads what a class or a text says: outside the elements above, text on the
same path as the article's own paragraphs, or a reader's comment as long and as dense as they are, is not told from them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, map_batches

#: Production parameters of op3: the part of the best path's score that content reaches; how often an article's text counts;
#: how many short containers alike are readers' remarks.
SHARE, ARTICLE, REMARKS = 0.4, 128, 3

#: Fixed values of HTML: elements without content, with raw text, of inline text, and those that end an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

#: What marks an element as no content by HTML's own rules: tags and roles.
FURNITURE = frozenset("head nav footer aside form button select menu dialog".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
#: Elements of running text: their container is the next element around them that is none of these.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary header hgroup".split())

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*))""", re.S)
PLAIN = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""\b(class|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"""[.,;:!?…。，、；：！？]""")


class Paths:
    """A tree of tag paths. Node 0 is the page; a node's number is greater than its parent's."""

    def __init__(self):
        self.children: list[dict[tuple[str, str], int]] = [{}]
        self.parent, self.step, self.inside = [0], [("", "")], [False]

    def child(self, node: int, tag: str, label: str) -> int:
        found = self.children[node].get((tag, label))
        if found is None:
            found = len(self.parent)
            self.children[node][tag, label] = found
            self.children.append({})
            self.parent.append(node)
            self.step.append((tag, label))
            self.inside.append(self.inside[node] or tag in ("article", "main"))
        return found

    def name(self, node: int) -> str:
        parts = []
        while node:
            tag, label = self.step[node]
            parts.append(f"{tag}.{label}" if label else tag)
            node = self.parent[node]
        return "/".join(reversed(parts))


class Tags:
    """The ends of tags, quoted values honoured. A quote that never closes is plain text.

    From each mark that is reached outside of quotes (a quote or `>`), where its tag ends is kept: all marks on the way to an
    end share it, so that the page is walked through once, whatever its quotes.
    """

    def __init__(self, html: str):
        self.html = html
        self.known: dict[int, int] = {}  # from a mark, where the tag's `>` is, or -1 where a quote stays open

    def end(self, at: int) -> tuple[int, int]:
        """Where the attributes that start here end, and where the tag does."""
        html, way, k = self.html, [], at
        while True:
            k = PLAIN.match(html, k).end()
            stop = self.known.get(k)
            if stop is not None:
                break
            if k == len(html):
                stop = -1
                break
            way.append(k)
            if html[k] == ">":
                stop = k
                break
            close = html.find(html[k], k + 1)
            if close < 0:
                stop = -1
                break
            k = close + 1
        self.known.update(dict.fromkeys(way, stop))
        if stop < 0:
            stop = html.find(">", at)
        return (stop, stop + 1) if stop >= 0 else (len(html), len(html))


def told(attributes: str) -> tuple[str, bool]:
    """The class names of an element, in order and without digits, and whether its role or `hidden` makes it no content."""
    label, gone = "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "role" and value in ROLES):
            gone = True
        elif name == "class" and not label:
            label = ".".join(sorted(re.sub(r"\d+", "", value).split()))
    return label, gone


@dataclass
class Page:
    """The blocks of a page in order, furniture and empty ones left out, and the tree of their paths.

    A block is the node of its path, its container, its text, and the characters of link text in it. Containers are
    numbered as they occur; `around` has the container around each, `of` its path; the page itself is 0.
    """

    paths: Paths
    blocks: list[tuple[int, int, str, int]]
    around: list[int]
    of: list[int]


def read(html: str) -> Page:
    paths, around, of = Paths(), [0], [0]
    out: list[tuple[int, int, str, int]] = []
    stack: list[tuple[str, bool, int, int]] = []  # block element, whether it is furniture, node, container
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = links = hidden = at = 0
    end, tags = len(html), Tags(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            if not hidden and (text := " ".join(unescape("".join(parts)).split())):
                out.append((*(stack[-1][2:] if stack else (0, 0)), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal hidden
        tag, own, _, _ = stack.pop()
        hidden -= own
        open_[tag] -= 1
        return tag

    while at < end:
        m = TAG.search(html, at)
        if m is None:
            break
        if m.start() > at and not hidden:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m[2] is None:
            continue
        stop, at = tags.end(at)
        tag, closing, attributes = m[2].lower(), bool(m[1]), html[m.end() : stop]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            links = max(0, links + (-1 if closing else 1)) if tag == "a" else links
        elif tag in VOID:
            flush()
        elif closing:
            if open_.get(tag):
                flush()
                while pop() != tag:
                    pass
                links = 0
        else:
            flush()
            ends = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else ())
            while stack and ends and stack[-1][0] in ends:
                pop()
            label, own = told(attributes) if attributes else ("", False)
            article = open_.get("article")
            own = tag not in ("html", "body", "main") and (own or tag in FURNITURE or (tag == "article" and bool(article)) or (tag == "header" and not (article or open_.get("main"))))
            node, container = stack[-1][2:] if stack else (0, 0)
            path = paths.child(node, tag, label)
            if tag not in FLOW and tag not in ("html", "body"):
                around.append(container)
                of.append(path)
                container = len(around) - 1
            stack.append((tag, own, path, container))
            open_[tag] = open_.get(tag, 0) + 1
            hidden += own
    if at < end and not hidden:
        parts.append(html[at:])
    flush()
    return Page(paths, out, around, of)


def remarks(page: Page, held: list[list[float]], own: dict[int, list[float]], where: dict[int, set[int]]) -> list[int]:
    """For each container how many alike it is one of, if they are like readers' remarks, else 1; so are those inside it.

    Remarks are at least REMARKS containers of one path in one container, with two blocks each at most, less text in each
    than a block of some other path has, and less in all than that path.
    """
    alike: dict[tuple[int, int], list[int]] = {}
    for c in range(1, len(held)):
        if held[c][2]:
            alike.setdefault((page.around[c], page.of[c]), []).append(c)
    outer = [1] * len(held)
    # Paths by the length of their blocks, and the largest of all that have longer ones.
    sizes = sorted(((row[3] / row[2], row[3], node) for node, row in own.items()), reverse=True)
    for group in alike.values():
        number, chars = (sum(held[c][k] for c in group) for k in (2, 3))
        if len(group) < REMARKS or number > 2 * len(group):
            continue
        inside = set(group)
        for mean, total, node in sizes:
            if mean <= chars / len(group):
                break
            if total > chars and not where[node] & inside:
                for c in group:
                    outer[c] = len(group)
                break
    for c in range(1, len(held)):  # a container comes after the one around it
        outer[c] = max(outer[c], outer[page.around[c]])
    return outer


def scores(page: Page) -> dict[int, float]:
    """The fused score of every path that has text."""
    own: dict[int, list[float]] = {}  # characters with links counted less, marks, blocks, characters, link text
    where: dict[int, set[int]] = {}
    held = [[0.0, 0, 0, 0] for _ in page.around]  # of containers, with those inside; the page's is its own running text
    for node, container, text, linked in page.blocks:
        row = (len(text) * (1 - 0.9 * linked / len(text)) ** 2, len(PUNCTUATION.findall(text)), 1, len(text))
        mine = own.setdefault(node, [0.0, 0, 0, 0, 0])
        mine[4] += linked
        where.setdefault(node, set()).add(container)
        for k, value in enumerate(row):
            mine[k] += value
            held[container][k] += value
    for container in range(len(held) - 1, 0, -1):
        if up := page.around[container]:
            for k, value in enumerate(held[container]):
                held[up][k] += value
    whole = sum(row[3] for row in own.values())
    many = remarks(page, held, own, where)
    out = {}
    for node, (length, marks, number, chars, linked) in own.items():
        # A container inside another of the same path is in it already.
        outer = [c for c in where[node] if page.around[c] not in where[node] or not page.around[c]]
        all_length, all_marks, all_number, all_chars = (sum(held[c][k] for c in outer) for k in range(4))
        smooth = (length / number + all_length / all_number) / 2
        dense = (marks / number + all_marks / all_number) / 2
        link = linked / chars
        part = all_chars / whole / min(many[c] for c in outer)
        out[node] = (smooth * (1 + dense) * part) ** (1 / 3) * (1 - 0.9 * link if link > 0.5 else 1) * (ARTICLE if page.paths.inside[node] else 1)
    return out


def main_text(html: str, share: float = SHARE) -> str:
    page = read(html)
    if not page.blocks:
        return ""
    fused = scores(page)
    best = max(fused.values())
    return " ".join(text for node, _, text, _ in page.blocks if fused[node] >= share * best)


def extracted(pages: DataFrame, html_col: str = "html", name: str = "text", share: float = SHARE) -> DataFrame:
    """`pages` with the main text of each row's html instead of the html; no shuffle.

    A null or empty page, or one of furniture alone, has an empty text. All other columns and repeated rows stay, a column
    of the new name is replaced; broken markup is read as far as it goes and whole pages are read whatever their length.
    """
    pages = pages.drop(*([name] if name != html_col else []))
    kept = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*kept, T.StructField(name, T.StringType())])

    def run(batches):
        for part in in_chunks(batches, html_col):
            texts = [main_text(h, share) if h else "" for h in part.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(texts, pa.string())], names=schema.names)

    return map_batches(pages, run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For pages of one article in an `article` element, as those of the test tables, with the character references that they use.
SQL = r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
    t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<br>|</?p>|</?h1>', ' ', 'g'), '<[^>]+>', '', 'g'), '&quot;?', '"', 'g') AS x FROM a),
    d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
    SELECT page_id, url, text, length(text) AS n_chars FROM d"""
