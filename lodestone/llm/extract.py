"""HTML extraction with site template removal.

A page is read into a tree of elements. All block subtrees of a page, whatever they are
called, are hashed from their tags, classes and text; Spark counts per host in how many pages
with different articles each hash occurs. Subtrees that recur on many pages of their host are
deleted from all of them. Exempt is what makes up an article: its container, and inside a
marked article its paragraphs, headings, tables and lists of prose, which several articles may
share.

Only what recurrence can't decide is left to names: elements that HTML itself gives another
purpose than the article's (navigation, headers, footers, asides, forms, scripts), and classes,
ids and roles that say so. Inside a marked article a class counts only if all of its words are
known words of page frames, or if the element is mostly links. The text of what is left of the
page's article, in blocks, is the result.

A host's recurring subtrees are at most ``1 / share`` times the mean number of subtrees of its
pages, and those outside articles on ``many`` pages at most ``1 / many`` of their total. All
hosts' together are broadcast as sorted hashes if they are fewer than ``BROADCAST_HASHES``;
beyond that, pages are joined to their host's set on a salted key.

Reading a page takes time in proportion to its length, whatever it contains.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

#: At most so many hashes (some 50 MB as Python sets) are broadcast.
BROADCAST_HASHES = 500_000
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REFERENCE = re.compile(r"&#\d{9,};?")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCKS - {"dd", "dt", "li", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "caption", "legend", "body", "html"}
#: What a start tag ends, if it is open above the nearest element of the second set.
IMPLIED = {
    "p": ({"p"}, {"button", "td", "th", "caption", "object"}),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: The entry of IMPLIED that a start tag follows, but for those that end a paragraph.
ENDS = {tag: name for name, (tags, _) in IMPLIED.items() for tag in tags}
#: The entries of IMPLIED that an element opens (true) or hides (false) for what is in it.
OPENS = {tag: {n: tag in opens for n, (opens, hides) in IMPLIED.items() if tag in opens | hides} for opens, hides in IMPLIED.values() for tag in opens | hides}
#: Elements that are never part of an article.
DROP = frozenset("head script style noscript template nav header footer aside form button select datalist option textarea input iframe object embed applet svg canvas audio video map dialog menu noembed noframes title xmp".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in a class or id that name a part of the frame.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "social share sharing breadcrumb breadcrumbs menu submenu nav navbar navigation topbar sidebar aside widget widgets related recommended recommendations comment comments commentlist disqus respond replies footer header masthead toolbar pagination pager skip search login copyright disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Prose: never deleted as a template inside an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr tbody thead tfoot caption".split())
#: Containers of prose, exempt inside an article unless they are mostly links.
LISTS = frozenset("ul ol dl table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that go with a frame word in a class without giving it another meaning.
NEUTRAL_WORDS = frozenset(
    "area articles bar block blocks body bottom box btn button buttons card cards col column container content entry field form global group head header heading icon icons inner item items js label left link links list lists main message module nav outer page pages panel post posts primary right row secondary section sections site slot small static stories story strip text title top unit us wrap wrapper".split()
)


class Node:
    __slots__ = ("tag", "words", "framed", "role", "hidden", "up", "items", "digest", "main", "size", "linked", "within", "scope")

    def __init__(self, tag: str, attributes: str, up: "Node | None"):
        self.tag, self.up, self.items = tag, up, []
        self.words, self.framed, self.role, self.hidden = frozenset(), False, "", False
        if attributes and not attributes.isspace():
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            named = f"{found.get('class', '')} {found.get('id', '')}"
            if named != " ":
                parts = [frozenset(x.lower() for x in _PART.findall(name)) for name in named.split()]
                self.words = frozenset().union(*parts)
                self.framed = any(x & FRAME_WORDS and x <= FRAME_WORDS | NEUTRAL_WORDS for x in parts)
            self.role = found.get("role", "").lower()
            self.hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        #: Inside an article or main element; and the nearest open element of each entry of IMPLIED.
        self.within = up is not None and (up.within or up.tag in ("article", "main") or up.role == "main")
        self.scope = up.scope if up is not None else {}
        if tag in OPENS:
            self.scope = {**self.scope, **{n: self if opens else None for n, opens in OPENS[tag].items()}}


class Tags:
    """Finds where tags end, in time proportional to the page: what is searched for once in
    vain is not searched for again."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "<>\"'"}
        self.quotes = True  # until a tag with quoted values turns out never to end

    def quoted(self, at: int, start: int) -> bool:
        """Whether the quotation mark at ``at`` opens a value: it follows an equals sign."""
        before = at - 1
        while before > start and self.source[before].isspace():
            before -= 1
        return self.source[before] == "=" and at < self.last[self.source[at]]

    def end(self, start: int) -> int:
        """The place of the > that ends the tag at ``start``; -1 if none does."""
        if start > self.last[">"]:
            return -1
        at = start
        while self.quotes:
            m = _STOP.search(self.source, at)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            elif self.quoted(m.start(), start):
                at = self.source.index(m[0], m.end()) + 1
            else:
                at = m.end()
        return self.source.index(">", start)


def unescape(text: str) -> str:
    """Character references decoded; those of numbers too long to be a character's give the
    replacement character, as all that name none do."""
    return _html.unescape(_REFERENCE.sub("\uFFFD", text)) if "&" in text else text


def parse(source: str) -> list[Node]:
    """All elements of a page in the order of their start tags; the first is the root."""
    root = node = Node("#root", "", None)
    nodes, is_open = [root], Counter()
    at = 0

    def close(until: Node) -> None:
        nonlocal node
        while node is not until:
            is_open[node.tag] -= 1
            node = node.up
        is_open[node.tag] -= 1
        node = node.up

    tags, held = Tags(source), 0  # text from ``held`` on is not in the tree yet
    while True:
        at = source.find("<", at) if at <= tags.last["<"] else -1
        if at < 0:
            if held < len(source):
                node.items.append(unescape(source[held:]))
            break
        closing = source.startswith("/", at + 1)
        name = _NAME.match(source, at + 1 + closing, min(at + 256, len(source)))
        other = not closing and name is None and source.startswith(("!", "?"), at + 1)
        stop = tags.end(at) if name else -1
        if not other and stop < 0:
            at += 1
            continue
        if held < at:
            node.items.append(unescape(source[held:at]))
        if other:
            if source.startswith(("<!--", "<![CDATA["), at):
                mark = "-->" if source.startswith("<!--", at) else "]]>"
                stop = source.find(mark, at + 4)
                stop = len(source) if stop < 0 else stop
                if mark == "]]>":
                    node.items.append(source[at + 9 : stop])
                at = held = min(stop + 3, len(source))
            else:
                stop = source.find(">", at) if at < tags.last[">"] else -1
                at = held = stop + 1 if stop >= 0 else len(source)
            continue
        tag, attributes = name[0].lower(), source[name.end() : stop]
        at = held = stop + 1
        if closing:
            if is_open[tag] > 0:
                x = node
                while x.tag != tag:
                    x = x.up
                close(x)
            continue
        if tag in ("html", "body") and is_open[tag] > 0:
            continue
        for entry in ("p" if tag in CLOSES_P else None, ENDS.get(tag)):
            if entry and node.scope.get(entry) is not None:
                close(node.scope[entry])
        if tag in HEADINGS and node.tag in HEADINGS:
            close(node)
        child = Node(tag, attributes, node)
        node.items.append(child)
        nodes.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = source.find(">", found.start()) if found else -1
            at = held = stop + 1 if stop >= 0 else len(source)
            continue
        node = child
        is_open[tag] += 1
    return nodes


def measure(nodes: list[Node]) -> None:
    """Digest, amount of text, amount of linked text, and whether an article is inside, of
    every element, children first."""
    for n in reversed(nodes):
        n.size = n.linked = 0
        n.main = n.tag == "main" or n.role == "main" or n.tag == "article" and not n.words & COMMENT_WORDS
        h = xxhash.xxh64(f"{n.tag} {' '.join(sorted(n.words))}")
        for x in n.items:
            if isinstance(x, Node):
                n.size, n.linked, n.main = n.size + x.size, n.linked + x.linked, n.main or x.main
                h.update(x.digest.to_bytes(8, "little"))
            elif not x.isspace():
                text = " ".join(x.split())
                n.size += len(text)
                h.update(text.encode("utf-8", "surrogatepass"))
            else:
                h.update(b" ")
        if n.tag == "a":
            n.linked = n.size
        n.digest = h.intdigest()


def dropped(n: Node) -> bool:
    """What HTML or its author says is no part of an article. A container of the article
    stays whatever it is called."""
    if n.tag in ("#root", "html", "body", "main"):
        return False
    if n.tag in DROP or n.hidden or n.role in DROP_ROLES:
        return True
    if n.tag == "article":
        return bool(n.words & COMMENT_WORDS) or not n.main
    if n.main or n.tag in HEADINGS or not n.words & FRAME_WORDS:
        return False
    return not n.within or n.framed or 2 * n.linked > n.size


def exempt(n: Node) -> bool:
    """What recurrence never deletes: an article's container, and prose inside one."""
    return n.main or n.within and (n.tag in PROSE or n.tag in LISTS and 2 * n.linked <= n.size)


def recurring(nodes: list[Node], templates: frozenset[int] | set[int]) -> tuple[set[int], int]:
    """Ids of elements that are a template or inside one, and the number of whole templates."""
    out: set[int] = set()
    found = 0
    for n in nodes if templates else ():
        if id(n.up) in out:
            out.add(id(n))
        elif n.tag in BLOCKS and n.size and n.digest in templates and not exempt(n):
            out.add(id(n))
            found += 1
    return out, found


def outside(nodes: list[Node], gone: set[int] = frozenset()) -> set[int]:
    """Ids of elements that are in ``gone``, dropped or inside one that is."""
    out: set[int] = set(gone)
    for n in nodes:
        if id(n) not in out and (id(n.up) in out or dropped(n)):
            out.add(id(n))
    return out


def article(nodes: list[Node], out: set[int]) -> tuple[Node, bool]:
    """The element that holds the article, and whether the page marks it as one: the article
    or else main element with most text, or else the innermost element that holds nearly all
    of the text that isn't links."""
    for tags in (("article",), ("main",)):
        found = [n for n in nodes if (n.tag in tags or tags == ("main",) and n.role == "main") and id(n) not in out and n.size]
        if found:
            best = max(found, key=lambda n: n.size - n.linked)
            while best.up is not None and any(x is best.up for x in found):
                best = best.up
            return best, True
    own: dict[int, int] = {}
    for n in reversed(nodes):
        if id(n) not in out:
            own[id(n)] = sum(own.get(id(x), 0) if isinstance(x, Node) else len(x.strip()) for x in n.items) if n.tag != "a" else 0
    node = nodes[0]
    while True:
        inner = [x for x in node.items if isinstance(x, Node) and id(x) in own and x.tag in BLOCKS - PROSE]
        best = max(inner, key=lambda x: own[id(x)], default=None)
        if best is None or own[id(best)] < 0.9 * own[id(node)] or not own[id(best)]:
            return node, False
        node = best


def frame(source: str | None) -> tuple[int, list[int], list[int]]:
    """A digest of the page's article, the same for most near copies of it; and the digests of
    subtrees outside and inside marked articles that may be templates, named or not."""
    nodes = parse(source or "")
    measure(nodes)
    top, _ = article(nodes, outside(nodes))
    inside: set[int] = set()
    prose: set[int] = set()
    found: tuple[set[int], set[int]] = (set(), set())
    for n in nodes:
        if n is top or id(n.up) in inside:
            inside.add(id(n))
            if n.tag in PROSE and n.size:
                prose.add(n.digest)
        if n.size and n.tag in BLOCKS and n.tag not in ("html", "body", "head") and not exempt(n):
            found[n.within].add(n.digest)
    # three of the article's blocks, those of the smallest hashes, stand for it
    own = xxhash.xxh64(b"".join(x.to_bytes(8, "little") for x in sorted(prose)[:3])).intdigest() if prose else top.digest
    return own, sorted(found[0] - found[1]), sorted(found[1])


def main_text(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, one line each."""
    return extract(source, templates)[0]


def extract(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """The article's blocks, one line each, and the number of templates deleted."""
    nodes = parse(source or "")
    measure(nodes)
    gone, deleted = recurring(nodes, templates)
    out = outside(nodes, gone)
    top, marked = article(nodes, out)
    lines: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            lines.append(text)
        line.clear()

    stack: list[tuple[Node, int]] = [(top, 0)]
    while stack:
        n, i = stack.pop()
        if i == 0 and n.tag in BLOCKS:
            flush()
        while i < len(n.items):
            x = n.items[i]
            i += 1
            if not isinstance(x, Node):
                line.append(x)
            elif id(x) in out:
                if (x.tag == "header" or "header" in x.words) and id(x) not in gone:  # an article's own header has its title
                    if marked and x.up is top:
                        stack.append((n, i))
                        stack.append((_titles(x, out), 0))
                        break
            elif x.tag in ("br", "td", "th") or x.tag == "hr":
                line.append(" ")
                if x.items:
                    stack.append((n, i))
                    stack.append((x, 0))
                    break
            else:
                stack.append((n, i))
                stack.append((x, 0))
                break
        else:
            if n.tag in BLOCKS:
                flush()
            elif n.tag in ("td", "th"):
                line.append(" ")
    flush()
    return "\n".join(lines), deleted


def _titles(header: Node, out: set[int]) -> Node:
    """A header less everything but its headings, which are taken out of ``out``."""
    found = Node("header", "", None)
    stack: list[tuple[Node, bool]] = [(header, False)]
    while stack:
        x, kept = stack.pop()
        if x.tag in HEADINGS and not kept:
            found.items.append(x)
            kept = True
        if kept and not dropped(x):
            out.discard(id(x))
        stack += [(y, kept) for y in reversed(x.items) if isinstance(y, Node)]
    return found


def host_of(url: str) -> F.Column:
    """Lower-case host of a url column, without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def template_hashes(pages: DataFrame, html: str = "html", url: str = "url", share: float = 0.1, least: int = 3, many: int = 100) -> DataFrame:
    """(host, hash): subtrees on at least ``least`` pages of a host with different articles,
    and on at least ``share`` of these; outside marked articles ``many`` pages are enough.
    Pages without a host have no templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        for batch in batches:
            found = [frame(x) for x in batch.column(1).to_pylist()]
            lists = [pa.array([signed(x[i]) for x in found], pa.list_(pa.int64())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed([x[0] for x in found])), *lists], ["host", "content", "outer", "inner"])

    seen = pages.select(host_of(url).alias("host"), F.col(html).cast("string").alias("html")).where("host <> '' and html is not null").mapInArrow(run, "host string, content long, outer array<long>, inner array<long>")
    different = seen.groupBy("host", "content").agg(F.min(F.struct("outer", "inner")).alias("x")).select("host", "x.*")
    # kind 2 counts the host's pages on the way
    of = lambda kind, hashes: F.transform(hashes, lambda x: F.struct(x.alias("hash"), F.lit(kind).alias("kind")))
    each = different.select("host", F.explode(F.concat(of(0, F.col("outer")), of(1, F.col("inner")), F.array(F.struct(F.lit(0).cast("long").alias("hash"), F.lit(2).alias("kind"))))).alias("x"))
    n = each.groupBy("host", "x.hash", "x.kind").agg(F.count("*").alias("n"))
    n = n.where(F.col("n") >= least)
    total = n.where("kind = 2").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    often = (F.col("n") >= share * F.col("pages")) | (F.col("kind") == 0) & (F.col("n") >= many)
    return n.where("kind < 2").join(total, F.col("host") == F.col("h")).where(often).select("host", "hash").distinct()


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), share: float = 0.1, least: int = 3, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Kept columns with text, the article of the whole page in blocks, n_chars, its code
    points, and n_templates, the recurring subtrees deleted from the page.

    A null or empty html has an empty text. A page with a null url, or one without a host,
    loses no templates. White space inside a block becomes one space; blocks are joined by
    \\n; nothing else is dropped or capped. Repeated rows get equal results; other columns are
    ignored, and so are kept ones named like a result; an empty table gives an empty result."""
    spark = pages.sparkSession
    _spark.ship(spark)
    scratch = _spark.Scratch(spark)
    templates = scratch.put(template_hashes(pages, html, url, share, least), "templates")
    rows, names, out = _spark.carried(pages, keep, "text string, n_chars long, n_templates long", host=host_of(url), html=F.col(html).cast("string"))
    last = len(names)

    def extracted(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        found = [extract(x, s) for x, s in zip(batch.column(last + 1).to_pylist(), sets)]
        texts = [x[0] for x in found]
        columns = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x[1] for x in found], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], out.names)

    size = templates.count()
    if size <= broadcast_hashes:
        found: dict[str, set[int]] = {}
        for host, h in zip(*(x.to_pylist() for x in templates.select("host", "hash").toArrow().columns)):
            found.setdefault(host, set()).add(h % (1 << 64))
        shared = spark.sparkContext.broadcast(found)
        none: frozenset[int] = frozenset()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield extracted(batch, [shared.value.get(x, none) for x in batch.column(last).to_pylist()])

        return rows.mapInArrow(run, out)

    salts = 64  # of a host's pages, so that a host with a third of all pages is no single task
    sets = templates.groupBy("host").agg(F.collect_list("hash").alias("_set")).select(F.col("host").alias("_h"), "_set", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(_spark.made("html")), F.lit(salts)).cast("int"))
    joined = salted.join(sets, (F.col(_spark.made("host")) == sets["_h"]) & (salted["_salt"] == sets["_s"]), "left").select(*rows.columns, "_set")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield extracted(batch, [{h % (1 << 64) for h in x or ()} for x in batch.column("_set").to_pylist()])

    return joined.mapInArrow(run_joined, out)
