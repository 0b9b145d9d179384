"""Pages as trees of elements, and selectors over them.

with_tree() reads each page's markup once and adds `tree`: the page's text and its elements in document order. An element
holds the range of its descendants (id to last) and of its text (begin to stop), so that ancestors, regions and the text
of a whole region are comparisons of numbers. All else here is expressions over that column: no page meets another one,
nothing is shuffled, and Python sees a page only once.

A selector becomes an expression as well: tags, #id, .class, [attribute] with =, ~=, ^=, $=, *= and the flag i, joined by
descendants (space), children (>), next siblings (+) and alternatives (,).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

NODE = "struct<id:int,last:int,parent:int,tag:string,attrs:map<string,string>,begin:int,stop:int>"
TREE = f"struct<text:string,nodes:array<{NODE}>>"
NODE_ARROW = pa.struct([("id", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("begin", pa.int32()), ("stop", pa.int32())])
TREE_ARROW = pa.struct([("text", pa.string()), ("nodes", pa.list_(NODE_ARROW))])

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data em font i kbd label mark q s samp small span strong sub sup time tt u var wbr img input".split())
#: What a tag closes if it stands open, within the nearest of the elements that hold such tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}} | {t: {"p"} for t in "p div ul ol dl table section article h1 h2 h3 h4 h5 h6 form header footer nav figure hr main aside blockquote pre".split()}
HOLDS = frozenset("html body table ul ol dl select div article section nav main aside figure td th li dd".split())
#: Attribute under which a script's own text stands: it is no text of the page.
SCRIPT = "#text"

#: Text up to markup that is read alike by all: a start tag with quoted or no values, an end tag, a simple comment, a doctype.
ATTRIBUTE = r"""[ \t\n\r\f]+([a-zA-Z_][\w:-]*)(?:=(?:"([^"]*)"|'([^']*)'))?"""
TAG = rf"""(?:([a-zA-Z][a-zA-Z0-9]*)((?:{ATTRIBUTE})*)[ \t\n\r\f]*(/?)|/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*|!--[^<>-]*--|!(?:doctype|DOCTYPE)\s[^<>]*)"""
SIMPLE = re.compile(rf"([^<]*)(?:<{TAG}>|\Z)", re.ASCII)
ATTRIBUTE = re.compile(ATTRIBUTE, re.ASCII)
#: Elements whose text is no markup, for some or all versions of the parser, and those of them whose references stay as written.
OPAQUE, RAW = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split()), frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS)


class Tree(HTMLParser):
    """Elements in document order. Tags that are left open end where their parent ends; ends of nothing are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[list] = []
        self.text: list[str] = []
        self.size = 0

    def say(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            node[1], node[6] = len(self.nodes) - 1, self.size
            if node[3] not in INLINE:
                self.say(" ")

    def handle_starttag(self, tag, attrs):
        if closes := CLOSES.get(tag):
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][3]
                if name in closes:
                    self.close_to(depth)
                elif name in HOLDS:
                    break
        if tag not in INLINE:
            self.say(" ")
        node = [len(self.nodes), len(self.nodes), self.open[-1][0] if self.open else -1, tag, {k: v or "" for k, v in reversed(attrs)}, self.size, self.size]
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][3] == tag:
                return self.close_to(depth)

    def handle_data(self, data):
        if self.open and self.open[-1][3] in ("script", "style"):
            node = self.open[-1]
            node[4][SCRIPT] = node[4].get(SCRIPT, "") + data
        else:
            self.say(data)


def read_simply(html: str) -> Tree | None:
    """The tree of a page whose markup is SIMPLE throughout, in a fraction of the parser's time; None of any other page."""
    tree, at, size, within, raw = Tree(), 0, len(html), "", False
    while at < size:
        found = SIMPLE.match(html, at)
        if not found:
            return None
        text, tag, attrs, _, _, _, empty, ended = found.groups()
        if within and (ended is None or ended.lower() != within):
            return None
        if text:
            tree.handle_data(text if raw or "&" not in text else unescape(text))
        within, raw = "", False
        if tag:
            tag = tag.lower()
            pairs = [(name.lower(), unescape(one or other)) for name, one, other in ATTRIBUTE.findall(attrs)] if attrs else ()
            if empty:
                tree.handle_startendtag(tag, pairs)
            else:
                tree.handle_starttag(tag, pairs)
                within, raw = tag if tag in OPAQUE else "", tag in RAW
        elif ended:
            tree.handle_endtag(ended.lower())
        at = found.end()
    return None if within else tree


def parsed(html: str | None) -> Tree:
    tree = read_simply(html or "")
    if tree is None:
        tree = Tree()
        tree.feed(html)
        tree.close()
    tree.close_to(0)
    return tree


def trees_of(pages: list[str | None]) -> pa.StructArray:
    """The pages' trees, made column by column: a dictionary for each element would cost more than reading the markup."""
    trees = [parsed(t) for t in pages]
    nodes = [n for t in trees for n in t.nodes]
    ends = lambda sizes: pa.array([0, *accumulate(sizes)], pa.int32())
    attrs = pa.MapArray.from_arrays(ends(len(n[4]) for n in nodes), pa.array([k for n in nodes for k in n[4]], pa.string()), pa.array([v for n in nodes for v in n[4].values()], pa.string()))
    column = lambda i, kind: pa.array([n[i] for n in nodes], kind)
    columns = [attrs if field.name == "attrs" else column(i, field.type) for i, field in enumerate(NODE_ARROW)]
    listed = pa.ListArray.from_arrays(ends(len(t.nodes) for t in trees), pa.StructArray.from_arrays(columns, fields=list(NODE_ARROW)))
    return pa.StructArray.from_arrays([pa.array(["".join(t.text) for t in trees], pa.string()), listed], fields=list(TREE_ARROW))


def with_tree(pages: DataFrame, body: str = "html") -> DataFrame:
    """The pages, without their markup, with `tree`. Null and empty pages have no elements."""
    kept = [c for c in pages.columns if c != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # a tree takes some times its page
                part = batch.slice(start, 64)
                trees = trees_of(part.column(body).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), trees], names=[*kept, "tree"])

    return pages.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in pages.dtypes if n != body) + (", " if kept else "") + f"tree {TREE}")


# Selectors

PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<fold>[iI])?\s*)?\]""")
JOIN = re.compile(r"\s*([>+,])\s*|\s+")


def parsed_selector(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives, each a chain of (how it hangs on the one before, tests)."""
    out, chain, tests, how, at, text = [], [], [], "", 0, selector.strip()
    while at < len(text):
        if found := PART.match(text, at):
            if found["tag"] and tests:
                raise ValueError(f"a tag amid a selector's part: {selector}")
            tests.append({k: v for k, v in found.groupdict().items() if v is not None})
        elif (found := JOIN.match(text, at)) and tests:
            chain.append((how, tests))
            how, tests = found[1] or " ", []
            if how == ",":
                out.append(chain)
                chain, how = [], ""
        else:
            raise ValueError(f"no selector: {selector}")
        at = found.end()
    if not tests:
        raise ValueError(f"no selector: {selector}")
    return [*out, [*chain, (how, tests)]]


def passes(node: Column, tests: list[dict]) -> Column:
    """Whether an element passes all tests of one part."""
    out = F.lit(True)
    for t in tests:
        if "tag" in t:
            one = F.lit(True) if t["tag"] == "*" else node["tag"] == t["tag"].lower()
        elif "id" in t:
            one = node["attrs"]["id"] == t["id"]
        elif "cls" in t:
            one = F.array_contains(F.split(node["attrs"]["class"], r"\s+"), t["cls"])
        else:
            value, wanted = node["attrs"][t["name"].lower()], t.get("dq", t.get("sq", t.get("bare")))
            if "fold" in t:
                value, wanted = F.lower(value), wanted.lower()
            one = {
                None: lambda: value.isNotNull(), "=": lambda: value == wanted, "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted),
                "^=": lambda: value.startswith(wanted), "$=": lambda: value.endswith(wanted), "*=": lambda: F.contains(value, F.lit(wanted)),
            }[t.get("op")]() if wanted != "" or t.get("op") == "=" else F.lit(False)
        out = out & F.coalesce(one, F.lit(False))
    # Most elements of a page have no attributes, and one look tells.
    return out if all("tag" in t for t in tests) else (F.size(node["attrs"]) > 0) & out


def contains(outer: Column, inner: Column) -> Column:
    """Whether an element lies inside another one, or is it."""
    return (outer["id"] <= inner["id"]) & (inner["id"] <= outer["last"])


HANGS: dict[str, Callable[[Column, Column], Column]] = {
    " ": lambda a, n: (a["id"] < n["id"]) & (n["id"] <= a["last"]),
    ">": lambda a, n: a["id"] == n["parent"],
    "+": lambda a, n: (a["last"] + 1 == n["id"]) & (a["parent"] == n["parent"]),
}


def chained(nodes: Column, chain: list[tuple[str, list[dict]]]) -> Column:
    how, tests = chain[-1]
    if len(chain) == 1:
        return F.filter(nodes, lambda n: passes(n, tests))
    # Most pages have nothing that a chain starts with.
    below = lambda before: F.filter(nodes, lambda n: passes(n, tests) & F.exists(before, lambda a: HANGS[how](a, n)))
    return let(chained(nodes, chain[:-1]), lambda before: F.when(F.size(before) == 0, before).otherwise(below(before)))


def select(tree: Column, selector: str) -> Column:
    """The elements that a selector finds, in document order, each once."""
    alternatives, nodes = parsed_selector(selector), tree["nodes"]
    if all(len(chain) == 1 for chain in alternatives):
        either = lambda n: reduce(lambda a, b: a | b, [passes(n, c[0][1]) for c in alternatives])
        return F.filter(nodes, either)
    if len(alternatives) == 1:
        return chained(nodes, alternatives[0])
    ids = F.concat(*[F.transform(chained(nodes, chain), lambda n: n["id"]) for chain in alternatives])
    return let(ids, lambda found: F.filter(nodes, lambda n: F.array_contains(found, n["id"])))


def outside(found: Column, regions: Column) -> Column:
    """The elements that are not, and do not lie in, one of the regions."""
    return let(regions, lambda r: F.filter(found, lambda n: ~F.exists(r, lambda a: contains(a, n))))


def tidy(text: Column) -> Column:
    """White space of all kinds as single spaces, none at the ends; null if nothing is left."""
    return let(F.trim(F.regexp_replace(text, r"[\s  ]+", " ")), lambda t: F.when(t != "", t))


def text_of(tree: Column, node: Column) -> Column:
    """The text of an element and all in it."""
    return tidy(F.substring(tree["text"], node["begin"] + 1, node["stop"] - node["begin"]))


def first_text(tree: Column, selector: str) -> Column:
    return let(F.get(select(tree, selector), F.lit(0)), lambda n: text_of(tree, n))


def first_attribute(tree: Column, selector: str, name: str) -> Column:
    return tidy(F.get(select(tree, selector), F.lit(0))["attrs"][name])


def next_of(tree: Column, node: Column) -> Column:
    """The element that follows an element under the same parent; null if it is the last."""
    return F.get(F.filter(tree["nodes"], lambda n: (n["id"] == node["last"] + 1) & (n["parent"] == node["parent"])), F.lit(0))


# Configured reading

#: Words in the class or id of a region that shows other products.
SECONDARY = r"(?i)(^|[\s_-])(analog|analogs|analogue|analogues|recommend|recommendation|recommendations|related|similar|upsell|cross[-_ ]?sell)([\s_-]|$)"


def read_one(tree: Column, selector: str | None, *attributes: str) -> Column:
    """(value, ambiguous) of the one element that a selector finds: the first attribute that it has, else its text.

    Several elements, and one in a region of other products, are ambiguous; their values are never taken.
    """
    if not selector:
        return F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("ambiguous"))
    secondary = F.filter(tree["nodes"], lambda n: F.concat_ws(" ", n["attrs"]["class"], n["attrs"]["id"]).rlike(SECONDARY))

    def read(s: Column) -> Column:
        node = F.get(s["found"], F.lit(0))
        elsewhere = F.exists(s["secondary"], lambda a: (a["id"] < node["id"]) & (node["id"] <= a["last"]))
        sole = (F.size(s["found"]) == 1) & ~F.coalesce(elsewhere, F.lit(False))
        value = F.coalesce(*[node["attrs"][a] for a in attributes], text_of(tree, node))
        return F.struct(F.when(sole, tidy(value)).alias("value"), ((F.size(s["found"]) > 0) & ~sole).alias("ambiguous"))

    return let(F.struct(select(tree, selector).alias("found"), secondary.alias("secondary")), read)


def configured(pages: DataFrame, name: str | None = None, rating: str | None = None, reviews: str | None = None) -> DataFrame:
    """Adds `name`, `rating`, `reviews` as text by three selectors, and whether one of them was `ambiguous`."""
    tree = F.col("tree")
    read = pages.withColumns({"_name": read_one(tree, name, "content"), "_rating": read_one(tree, rating, "content", "data-rating"), "_reviews": read_one(tree, reviews, "content", "data-review-count")})
    return read.withColumns({"name": F.col("_name.value"), "rating": F.col("_rating.value"), "reviews": F.col("_reviews.value"), "ambiguous": F.col("_name.ambiguous") | F.col("_rating.ambiguous") | F.col("_reviews.ambiguous")}).drop("_name", "_rating", "_reviews")
