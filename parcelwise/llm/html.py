"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a page's tokens: a tree of labels in which children may be optional,
repeated or repeated groups, and texts are fixed or slots. It starts as one page and is aligned with one page after
another; what doesn't match becomes optional, what recurs side by side becomes repeated, and a text that differs becomes
a slot. Tasks align the pages they scan into one partial wrapper for each host, and partial wrappers of a host are
aligned with each other in the same way, in a fixed order, so no host's pages meet in one place.

Literals are found before neighbouring texts become one slot: blocks of text that at least ``OFTEN`` of a host's
different pages have, ``FIRM`` of them or more, counted over all of its pages.

Each page is then matched with its host's wrapper, child by child: optional parts may be missing, repeated ones take as
many children as fit. The place in the wrapper decides what a text is: slots inside the part that holds the host's
articles are main text; literals, texts that stay the same wherever their place is filled, and parts whose names say
what they are (menus, adverts, comments and the like) aren't.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: HTML elements by role, and words that name parts which aren't main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p h2 h3 h4 h5 h6 ul ol li blockquote pre table thead tbody tfoot tr td th caption dl dt dd figure figcaption hr address details summary".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPES = frozenset("table ul ol dl div article section main nav aside header footer form body html".split())
NOT_TEXT = frozenset("head script style noscript template svg math iframe object canvas nav aside footer form button select textarea input label dialog menu audio video map title".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "cookie cookies consent gdpr notice notices notification popup modal overlay comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription "
    "signup login search form widget pagination pager toolbar skip tags copyright legal side menubar topnav topbar dropdown crumbs alert discussion feedback".split()
)
#: Words that may stand beside those without changing what a name says.
PLAIN_WORDS = frozenset("article articles story stories site page top bottom left right main global primary secondary list box block wrap wrapper container section area item items inner outer links link posts post bar media buttons icons text content unit slot row col column head body reader readers user users visitor new latest recent more all count js is has active open sticky fixed small large full half desktop mobile sm md lg xl xs".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Levels that keep elements of their own; what is nested deeper belongs to the element at this level, as in browsers.
LEVELS = 200
#: Different pages on which a text must be the same to count as fixed, children that a wrapper keeps in order, and kinds of them that it tells apart by name.
FIRM, IN_ORDER, NAMED = 5, 40, 200
#: The share of a host's different pages that have a literal.
OFTEN = 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("aside", "children", "label", "tag")

    def __init__(self, tag: str, label: str, aside: int):
        self.tag, self.label, self.aside, self.children = tag, label, aside, []


#: Why an element isn't main text: what it is, or only what its name says.
BY_KIND, BY_NAME = 2, 1


def words_of(name: str) -> list[str]:
    return [w.lower() for w in NAME_PART.findall(name)]


def names_aside(name: str) -> bool:
    """Whether a class or id says that a part isn't main text: every word of it must be one of those known."""
    words = words_of(name)
    return not ASIDE_WORDS.isdisjoint(words) and all(len(w) == 1 or w in ASIDE_WORDS or w in PLAIN_WORDS for w in words)


def opened(tag: str, attributes: str) -> Node:
    """An element: its label has the first name of its class or id, digits left out."""
    aside, name = BY_KIND * (tag in NOT_TEXT), ""
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                words = words_of(value)
                name = name or (f"{'.' if key == 'class' else '#'}{'-'.join(words[:3])}" if words else "")
                if tag not in ("html", "body", "main") and any(map(names_aside, value.split())):
                    aside |= BY_NAME
            elif key == "role":
                aside |= BY_KIND * (value.lower() in ASIDE_ROLES)
                name = ".main" if value.lower() == "main" else name
            elif key == "style":
                aside |= BY_KIND * (re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) is not None)
            else:
                aside |= BY_KIND * (key == "hidden" or value.lower() == "true")
    return Node(tag, tag + name, aside)


def parsed(page: str) -> Node:
    """The page as a tree of elements and texts (str); inline elements dissolve into the text around them, ``br`` into white space."""
    root = Node("#page", "#page", 0)
    # open tags and the element that each one's content belongs to
    tags, owners = ["#page"], [root]
    at, n = 0, len(page)

    def text(value: str) -> None:
        if value:
            top = owners[-1].children
            if top and isinstance(top[-1], list):
                top[-1].append(value)
            else:
                top.append([value])

    def close(k: int) -> None:
        del tags[k:], owners[k:]

    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        if (tag := found[2] or found[5]) is None:
            if found[0].startswith("<![CDATA["):
                text(entities_kept(found[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if tag == "br":
            text(" ")
            continue
        if closing:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == tag:
                    close(k)
                    break
                if (tag in INLINE and tags[k] not in INLINE) or (tags[k] in SCOPES and tag in FLOW):
                    break
            continue
        node = opened(tag, attributes)
        # inline elements are kept only where one of them isn't main text
        if tag in INLINE and not node.aside and tags[-1] not in INLINE:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            if not node.aside:
                node.children.append([page[at : end.start() if end else n]])
                owners[-1].children.append(node)
            at = stop + 1 if stop >= 0 else n
            continue
        if tag in ENDS_PARAGRAPH:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == "p":
                    close(k)
                if tags[k : k + 1] != [] and tags[k] not in INLINE:
                    break
        if tag in ("article", "main") and "nav" in tags:
            close(tags.index("nav"))
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in CLOSES.get(tag, ()):
                close(k)
                break
            if tags[k] in SCOPES:
                break
        if tag == "header" and not any(x in ("article", "main") for x in tags):
            node.aside |= BY_KIND
        deep = len(tags) > LEVELS
        if not deep or tag in VOID:
            owners[-1].children.append(node)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            tags.append(tag)
            owners.append(owners[-1] if deep else node)
    joined(root)
    return root


def joined(root: Node) -> None:
    """Make each run of text pieces one string."""
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = ["".join(c) if isinstance(c, list) else c for c in x.children]
        todo += [c for c in x.children if isinstance(c, Node)]


def entities_kept(value: str) -> str:
    return value.replace("&", "&amp;")


def clean(value: str) -> str:
    return " ".join(entities.unescape(value).split())


def content(node: Node, aside: int) -> str:
    """The text below an element in page order, without those parts that ``aside`` (a mask of reasons) leaves out."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if value := clean(x):
                out.append(value)
        elif x is node or not x.aside & aside:
            todo += reversed(x.children)
    return " ".join(out)


# A wrapper node is a list: label, flags, characters, the fixed text's digest or None, the different pages seen, children.
OPTIONAL, REPEATED, KIND, NAME = 1, 2, 4, 8
LABEL, FLAGS, CHARS, FIXED, PAGES, CHILDREN = range(6)
TEXT, GROUP, ANY = "#text", "#group", "#any"


def digest(value: str) -> str:
    return hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=12).hexdigest()


def parts(node: Node, aside: int) -> list[tuple[str, object]]:
    """An element's children as (label, text) of blocks that aren't empty and (label, element): texts and flow elements are blocks."""
    out: list[tuple[str, object]] = []
    for x in node.children:
        if isinstance(x, str):
            if value := clean(x):
                out.append((TEXT, value))
        elif x.tag in FLOW and not x.aside:
            if value := content(x, aside):
                out.append((TEXT, value))
        else:
            out.append((x.label, x))
    return out


def wrapper(page: Node) -> list:
    """A page as a wrapper of its own, see ``built_from``."""
    return built_from(page)[0]


def built_from(page: Node) -> tuple[list, str, set[str]]:
    """A page as a wrapper of its own, its mark, and its blocks of text outside its asides as digest:length. The page counts by the texts outside its asides, so copies of an article under one frame count once."""
    said: list[str] = []

    def built(node: Node, aside: int) -> list:
        children: list[list] = []
        for label, x in parts(node, BY_KIND | BY_NAME):
            if label == TEXT:
                said.extend([x] * (not aside))
                children.append([TEXT, 0, len(x), digest(x), [], []])
            else:
                children.append(built(x, aside | x.aside))
        children = settled(repeats(children))
        flags = KIND * (node.aside & BY_KIND > 0) | NAME * (node.aside & BY_NAME > 0)
        return [node.label, flags, sum(c[CHARS] for c in children), "", [], children]

    whole = built(page, 0)
    mark, todo = digest("\n".join(said))[:12], [whole]
    while todo:
        x = todo.pop()
        x[PAGES] = [mark]
        todo += x[CHILDREN]
    return whole, mark, {f"{digest(x)}:{len(x)}" for x in said}


def repeats(children: list[list]) -> list[list]:
    """Children with equal neighbours, or equal neighbouring runs of up to four, merged into one that is repeated."""
    for width in (1, 2, 3, 4):
        k = 0
        out: list[list] = []
        while k < len(children):
            run = children[k : k + width]
            labels = [c[LABEL] for c in run]
            end = k + width
            if len(run) == width and (width == 1 or len(set(labels)) > 1):
                while [c[LABEL] for c in children[end : end + width]] == labels:
                    run = [merged(a, b) for a, b in zip(run, children[end : end + width], strict=True)]
                    end += width
            if end > k + width:
                if width == 1:
                    run[0][FLAGS] |= REPEATED
                    out.append(run[0])
                else:
                    out.append(group(GROUP, run))
                k = end
            else:
                out.append(children[k])
                k += 1
        children = out
    return children


def group(label: str, members: list[list]) -> list:
    return [label, REPEATED, sum(c[CHARS] for c in members), "", few(x for c in members for x in c[PAGES]), members]


def few(pages) -> list[str]:
    """The least ``FIRM`` different pages: all that is asked of them is whether there are so many."""
    return sorted(set(pages))[:FIRM]


def settled(children: list[list]) -> list[list]:
    """Children too many to keep in order as one repeated group, each label in it once and optional; by tag alone where even labels are too many."""
    if len(children) <= IN_ORDER and not any(c[LABEL] == ANY for c in children):
        return children
    loose = [m for c in children for m in (c[CHILDREN] if c[LABEL] in (ANY, GROUP) else [c])]
    held: dict[str, list] = {}
    for plain in (False, True):
        held = {}
        for c in loose:
            if plain and c[LABEL] != TEXT:
                c = [re.split(r"[.#]", c[LABEL])[0], *c[1:]]
            held[c[LABEL]] = merged(held[c[LABEL]], c) if c[LABEL] in held else c
        if len(held) <= NAMED:
            break
    for c in held.values():
        c[FLAGS] |= OPTIONAL | REPEATED
    return [group(ANY, [held[k] for k in sorted(held)])]


def merged(a: list, b: list) -> list:
    """The wrapper of both: children aligned by label, what only one has becomes optional, texts that differ become slots."""
    # a name that only some of these elements have says nothing about all of them
    names = a[FLAGS] & b[FLAGS] & (NAME | KIND)
    return [a[LABEL], (a[FLAGS] | b[FLAGS]) & (OPTIONAL | REPEATED) | names, a[CHARS] + b[CHARS], a[FIXED] if a[FIXED] == b[FIXED] else None, few(a[PAGES] + b[PAGES]), aligned(a[CHILDREN], b[CHILDREN])]


def aligned(a: list[list], b: list[list]) -> list[list]:
    left, right = [c[LABEL] for c in a], [c[LABEL] for c in b]
    if left == right and ANY not in left:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    if ANY in left or ANY in right:
        return settled([*a, *b])
    out: list[list] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            for c in (*a[i:j], *b[k:m]):
                c[FLAGS] |= OPTIONAL
                out.append(c)
    return settled(repeats(out))


def fixed(node: list) -> bool:
    """Whether a text is the host's own: the same on every page that has it, and those are ``FIRM`` different ones at least."""
    return node[FIXED] is not None and len(node[PAGES]) >= FIRM


def slots(node: list, aside: int) -> int:
    """Characters of the slots below a wrapper node outside its ``aside`` parts."""
    return sum((c[CHARS] * (not fixed(c)) if c[LABEL] == TEXT else slots(c, aside)) for c in node[CHILDREN] if not c[FLAGS] & aside)


def rule(whole: list) -> dict:
    """What a wrapper says of its pages: where the articles are (labels from the top), and the expression of that part.

    The part is the ``article`` or ``main`` element with the most slot text, or, without one, the deepest element that
    holds most of all slot text. If the names of parts left nothing, they aren't believed. A host whose texts hardly
    differ tells nothing of fixed ones.
    """
    aside = KIND | NAME if slots(whole, KIND | NAME) or not slots(whole, KIND) else KIND
    best: dict[str, tuple[int, list[str], list]] = {}

    def look(node: list, path: list[str]) -> None:
        for child in node[CHILDREN]:
            if child[FLAGS] & aside or child[LABEL] == TEXT:
                continue
            at = path if child[LABEL] in (GROUP, ANY) else [*path, child[LABEL]]
            kind = "article" if re.split("[.#]", child[LABEL])[0] == "article" else "main" if re.match(r"main\b|\w+\.main$", child[LABEL]) else ""
            if kind and slots(child, aside) > best.get(kind, (-1,))[0]:
                best[kind] = (slots(child, aside), at, child)
            if kind != "article":
                look(child, at)

    look(whole, [])
    if found := best.get("article") or best.get("main"):
        _, path, node = found
    else:
        node, path = whole, []
        while True:
            # a repeated part is one of several that hold text, not the place of all
            inner = [c for c in node[CHILDREN] if not c[FLAGS] & (aside | REPEATED) and c[LABEL] != TEXT]
            top = max(inner, key=lambda c: slots(c, aside), default=None)
            if top is None or slots(top, aside) < 0.7 * slots(node, aside) or slots(top, aside) == 0:
                break
            node, path = top, [*path, top[LABEL]]
    said = 0

    def told(x: list) -> list:
        """A node as the expression needs it: label, repeated or not, whether it is left out, the digest of a fixed text, children."""
        nonlocal said
        out = bool(x[FLAGS] & aside)
        held = x[FIXED] if x[LABEL] == TEXT and fixed(x) else None
        said += x[CHARS] * (held is not None and not out)
        return [x[LABEL], bool(x[FLAGS] & REPEATED), out, held, [] if out else [told(c) for c in x[CHILDREN]]]

    expression = told(node)
    return {"path": path, "expression": expression, "fixed": slots(node, aside) > said, "aside": BY_KIND | BY_NAME * (aside & NAME > 0)}


class Expression:
    """The children of a wrapper node, laid out for matching: each with where its repeated run begins."""

    def __init__(self, children: list[list]):
        self.nodes: list[list] = []
        self.back: list[int] = []
        for c in children:
            members = c[4] if c[0] in (GROUP, ANY) else [c]
            first = len(self.nodes)
            for m in members:
                self.back.append(first if c[1] else first + 1 if c is m else len(self.nodes) + 1)
                self.nodes.append(m)
        self.places: dict[str, list[int]] = {}
        for k, m in enumerate(self.nodes):
            self.places.setdefault(m[0], []).append(k)
        self.below: dict[int, Expression] = {}

    def find(self, label: str, after: int) -> int | None:
        """The next place for a child of this label after the place of the one before; within a repeated run from its start again, anywhere if nothing else is left."""
        places = self.places.get(label) or self.places.get(re.split("[.#]", label)[0])
        if not places:
            return None
        k = bisect.bisect_left(places, after + 1)
        again = bisect.bisect_left(places, self.back[after]) if after >= 0 else k
        if after >= 0 and again < len(places) and places[again] <= after:
            return places[again] if k == len(places) or self.back[after] <= places[again] else places[k]
        return places[k] if k < len(places) else places[0]

    def child(self, k: int) -> Expression:
        if k not in self.below:
            self.below[k] = Expression(self.nodes[k][4])
        return self.below[k]


def matched(node: Node, expression: Expression, where: dict, literals: frozenset[str], out: list[str]) -> None:
    """Add an element's main text to ``out``, its children matched with those of the wrapper one after another."""
    at = -1
    for label, x in parts(node, where["aside"]):
        place = expression.find(label, at)
        said = None
        if place is not None:
            at, said = place, expression.nodes[place]
        if label == TEXT:
            mark = digest(x) if literals or (said and said[3]) else ""
            if mark not in literals and not (said and said[3] and where["fixed"] and said[3] == mark):
                out.append(x)
        elif said is not None and not x.aside & BY_KIND:
            if not said[2]:
                matched(x, expression.child(place), where, literals, out)
        elif not x.aside & where["aside"]:
            if value := content(x, where["aside"]):
                out.append(value)


def extracted(tree: Node, where: dict, literals: frozenset[str] = frozenset()) -> str | None:
    """The main text of a page by a rule and its host's literals; None if the page has no such place. A page of literals alone is one that its host shows again and again: its text stays."""
    level = [tree]
    for label in where["path"]:
        inner = [c for x in level for c in x.children if isinstance(c, Node) and not c.aside & where["aside"]]
        level = [c for c in inner if c.label == label] or [c for c in inner if c.tag == label]
    if not level:
        return None
    if "matcher" not in where:
        where["matcher"] = Expression(where["expression"][4])
    out: list[str] = []
    for x in level:
        matched(x, where["matcher"], where, literals, out)
    return extracted(tree, where) if literals and not out else " ".join(out)


def host_of(url):
    """The host of a URL column, lower case, without credentials, port or ``www.``; empty if it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


#: Hosts whose wrappers a task holds at a time.
HELD_HOSTS = 2000


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, rule, literals): for each host its wrapper and what follows from it, as JSON, and the digests of its literals."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    schema = "host string, wrapper string, mark string, block string"

    def passed_on(held: dict[str, list]):
        for host, own in held.items():
            yield pa.record_batch({"host": [host], "wrapper": [json.dumps(own)], "mark": pa.array([None], pa.string()), "block": pa.array([None], pa.string())})

    def scan(batches):
        """Partial wrappers, and a row for each page and block; a task passes on the wrappers it holds after so many hosts, whose parts then meet with the others."""
        held: dict[str, list] = {}
        for b in batches:
            hosts, marks, blocks = [], [], []
            for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
                own, mark, said = built_from(parsed(page))
                held[host] = merged(held[host], own) if host in held else own
                for block in ("", *said):  # the page itself as a block without text
                    hosts.append(host)
                    marks.append(mark)
                    blocks.append(block)
                if len(held) >= HELD_HOSTS:
                    yield from passed_on(held)
                    held = {}
            yield pa.record_batch({"host": hosts, "wrapper": pa.array([None] * len(hosts), pa.string()), "mark": marks, "block": blocks}) if hosts else pa.RecordBatch.from_pylist([], pa.schema([(c, pa.string()) for c in ("host", "wrapper", "mark", "block")]))
        yield from passed_on(held)

    def meet(batches):
        """Partial wrappers come sorted by host; one host is held at a time."""
        now, held = None, None
        for b in batches:
            for host, own in zip(b["host"].to_pylist(), b["wrapper"].to_pylist(), strict=True):
                if host == now:
                    held = merged(held, json.loads(own))
                    continue
                if held is not None:
                    yield finished(now, held)
                now, held = host, json.loads(own)
        if held is not None:
            yield finished(now, held)

    def finished(host: str, own: list):
        return pa.record_batch({"host": [host], "wrapper": [json.dumps(own)], "rule": [json.dumps(rule(own))]})

    found = written(rows.mapInArrow(scan, schema), "partial-wrappers")
    # different pages with each block; copies of a page are one
    counts = found.where("wrapper IS NULL").select("host", "block", "mark").distinct().groupBy("host", "block").agg(F.count("*").alias("n"))
    size = F.substring_index("block", ":", -1).cast("long") * F.col("n")
    hosts = counts.groupBy("host").agg(F.max(F.when(F.col("block") == "", F.col("n"))).alias("pages"), F.sum(F.when(F.col("block") != "", size)).alias("said"))
    often = counts.where((F.col("n") >= FIRM) & (F.col("block") != "")).join(hosts, "host").where(F.col("n") >= OFTEN * F.col("pages"))
    literals = often.groupBy("host").agg(F.collect_list(F.substring_index("block", ":", 1)).alias("literals"), F.sum(size).alias("fixed"), F.first("said").alias("said"))  # at most blocks a page / OFTEN
    # where most of what a host says is literal, its pages are versions of one text
    literals = literals.where("fixed < 0.5 * said").select("host", "literals")
    whole = found.where("wrapper IS NOT NULL").select("host", "wrapper").repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(meet, "host string, wrapper string, rule string")
    return whole.join(literals, "host", "left")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(``key``, ``url``, text, n_chars) for each page.

    Null or empty html gives an empty text; a page without URL belongs to the host without a name. A page that lacks
    its host's place of main text is read by a wrapper of its own. Repeated rows each get their row; further columns
    are ignored, whatever their names. The rules of all hosts are broadcast only if they take less than
    ``broadcast_bytes``; else pages are joined with them by host, where Spark splits the pages of a hot host.
    """
    key_type = pages.schema[key].dataType.simpleString()
    rules = written(wrappers(pages, url, html).select("host", "rule", F.coalesce(F.array_join("literals", " "), F.lit("")).alias("literals")), "rules")
    held = rules.agg(F.sum(F.octet_length("rule") + F.octet_length("host") + F.octet_length("literals"))).first()[0] or 0
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    joined_rows = rows.join(F.broadcast(rules) if held < broadcast_bytes else rules, "host", "left").select("key", "url", "html", "rule", "literals")

    def run(batches):
        known: dict[str, dict] = {}
        fixed_of: dict[str, frozenset[str]] = {}
        for b in batches:
            out = []
            for page, said, fixed_texts in zip(b["html"].to_pylist(), b["rule"].to_pylist(), b["literals"].to_pylist(), strict=True):
                if not page:
                    out.append("")
                    continue
                if said not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[said] = json.loads(said)
                if fixed_texts not in fixed_of:
                    if len(fixed_of) >= HELD_HOSTS:
                        fixed_of.clear()
                    fixed_of[fixed_texts] = frozenset(fixed_texts.split())
                tree, literals = parsed(page), fixed_of[fixed_texts]
                value = extracted(tree, known[said], literals)
                out.append(extracted(tree, rule(wrapper(tree)), literals) or "" if value is None else value)
            yield pa.record_batch({"key": b["key"], "url": b["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return joined_rows.mapInArrow(run, f"key {key_type}, url string, text string, n_chars long").select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
