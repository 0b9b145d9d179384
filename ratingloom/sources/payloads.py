"""Readers of captured payloads: pages, embedded data, sitemaps, tables, datasets.

A payload is a row (id, url, kind, body). What built-in functions express stays in the JVM; markup that nests visits
Python in Arrow batches, one page at a time.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import written_once

PRODUCT_SCHEMA = "name string, sku string, url string, rating double, best double, reviews long, ratings long"
JSON_LD = re.compile(r"<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)
#: Nodes of one script from which a page is taken for an attack: an error, never a shorter result.
NODE_LIMIT = 20_000


def number(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    found = re.fullmatch(r"\s*(-?\d[\d\s ]*(?:[.,]\d+)?)\s*", str(value))
    return float(re.sub(r"[\s ]", "", found[1]).replace(",", ".")) if found else None


def ld_products(html: str) -> list[tuple]:
    """Products of a page's JSON-LD, graphs and lists walked breadth first; scripts that do not parse are passed over."""
    out = []
    for text in JSON_LD.findall(html or ""):
        try:
            queue = deque([json.loads(unescape(text.strip()) if "&quot;" in text else text)])
        except ValueError:
            continue
        seen = 0
        while queue:
            node = queue.popleft()
            seen += 1
            if seen > NODE_LIMIT:
                raise ValueError(f"JSON-LD of over {NODE_LIMIT} nodes")
            if isinstance(node, list):
                queue.extend(node)
            elif isinstance(node, dict):
                kinds = node.get("@type")
                if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                    score = node.get("aggregateRating") if isinstance(node.get("aggregateRating"), dict) else {}
                    whole = lambda v: int(n) if (n := number(v)) is not None and n >= 0 and n == int(n) else None
                    out.append((node.get("name"), None if node.get("sku") is None else str(node["sku"]), node.get("url"), number(score.get("ratingValue")), number(score.get("bestRating")), whole(score.get("reviewCount")), whole(score.get("ratingCount"))))
                queue.extend([v for k, v in node.items() if k in ("@graph", "mainEntity", "itemListElement", "item", "hasVariant") and isinstance(v, (dict, list))])
    return out


class Microdata(HTMLParser):
    """Values of schema.org properties in the order met."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {}
        self.open: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if name := attrs.get("itemprop"):
            if attrs.get("content") is not None:
                self.found.setdefault(name, []).append(attrs["content"])
            else:
                self.open.append((tag, name))
                self.found.setdefault(name, []).append("")

    def handle_data(self, data):
        if self.open:
            self.found[self.open[-1][1]][-1] += data

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            self.open.pop()


def microdata_product(html: str) -> tuple | None:
    """The one product that a page's microdata describes; none if a counter or rating is given two values."""
    parser = Microdata()
    parser.feed(html or "")
    one = lambda name: (lambda s: s.pop() if len(s) == 1 else None)({v.strip() for v in parser.found.get(name, [])})
    if any(len({v.strip() for v in parser.found.get(p, [])}) > 1 for p in ("ratingValue", "reviewCount", "ratingCount")):
        return None
    rating = number(one("ratingValue"))
    whole = lambda v: None if v is None else int(v)
    return (one("name"), one("sku"), None, rating, number(one("bestRating")), whole(number(one("reviewCount"))), whole(number(one("ratingCount")))) if rating is not None else None


def embedded_object(text: str, name: str) -> str | None:
    """The balanced {...} assigned to or keyed by a name in script text."""
    found = re.search(re.escape(name) + r"[\"']?\s*[:=]\s*\{", text or "")
    if not found:
        return None
    depth, quote, i = 0, "", found.end() - 1
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            if c == quote and text[j - 1] != "\\":
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[i : j + 1]
    return None


class Grid(HTMLParser):
    """Cells of a table with their spans spread out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: dict[tuple[int, int], str] = {}
        self.merges: list[tuple[int, int, int, int]] = []
        self.row, self.column, self.at = -1, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th") and self.row >= 0:
            attrs = dict(attrs)
            while (self.row, self.column) in self.cells:
                self.column += 1
            tall, wide = (max(1, int(attrs.get(k) or 1)) for k in ("rowspan", "colspan"))
            self.at = (self.row, self.column)
            for r in range(tall):
                for c in range(wide):
                    self.cells[self.row + r, self.column + c] = ""
            if tall * wide > 1:
                self.merges.append((self.row, self.row + tall, self.column, self.column + wide))
            self.column += wide

    def handle_data(self, data):
        if self.at:
            self.cells[self.at] += data

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.at = None


def parsed(payloads: DataFrame, key: str, body: str, schema: str, parse) -> DataFrame:
    """key and the rows that `parse` makes of each body."""
    names = [p.split()[0] for p in schema.split(", ")]
    kind = dict(payloads.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k, text in zip(frame[key], frame[body]) for row in parse(text)]
            yield pd.DataFrame(rows, columns=[key, *names], dtype=object)

    return payloads.select(key, body).mapInPandas(run, f"{key} {kind}, {schema}")


def json_ld(payloads: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    return parsed(payloads, key, body, PRODUCT_SCHEMA, ld_products)


def microdata(payloads: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    return parsed(payloads, key, body, PRODUCT_SCHEMA, lambda text: [p] if (p := microdata_product(text)) else [])


def table_cells(payloads: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    def parse(text: str) -> list[tuple]:
        grid = Grid()
        grid.feed(text or "")
        return [(r, c, v.strip()) for (r, c), v in sorted(grid.cells.items())]

    return parsed(payloads, key, body, "r int, c int, text string", parse)


def embedded_state(payloads: DataFrame, name: str, key: str = "page_id", body: str = "html") -> DataFrame:
    return parsed(payloads, key, body, "state string", lambda text: [(s,)] if (s := embedded_object(text, name)) else [])


def anchors(payloads: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """(href, text) of every anchor in order."""
    pattern = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("text"))
    found = payloads.select(key, F.posexplode(pairs).alias("place", "a"))
    return found.select(key, "place", F.col("a.href").alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a.text", "<[^>]*>", " "), r"\s+", " ")).alias("text"))


def locations(sitemap: Column) -> Column:
    """Addresses of a sitemap or of a sitemap index."""
    return F.transform(F.regexp_extract_all(sitemap, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda v: F.replace(v, F.lit("&amp;"), F.lit("&")))


def listed(captured: DataFrame, root: str, nested: str, url: str = "url", xml: str = "xml") -> DataFrame:
    """Addresses of the pages that a sitemap leads to, through captured sitemaps (`nested` in their address) of any depth.

    Each round reads the sitemaps that the round before has found, so there are as many rounds as the tree is deep; a
    sitemap met before is not read again.
    """
    links = captured.select(F.col(url).alias("parent"), F.explode(locations(F.col(xml))).alias("child"))
    inner = links.filter(F.contains("child", F.lit(nested))).distinct()
    known = found = captured.sparkSession.createDataFrame([(root,)], "parent string")
    while not found.isEmpty():
        found = written_once(inner.join(found, "parent").select(F.col("child").alias("parent")).distinct().join(known, "parent", "left_anti"), "sitemaps")
        known = known.union(found)
    return links.filter(~F.contains("child", F.lit(nested))).join(known, "parent", "left_semi").select(F.col("child").alias("url")).distinct()


def markup_of(text: Column) -> Column:
    """Plain text as paragraphs of markup, in which nothing of the text is markup."""
    safe = F.coalesce(text, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(entity))
    return F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))


def rows_of_columns(records: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of records whose columns are arrays; arrays of different lengths fail the query instead of padding with nulls."""
    sizes = [F.size(c) for c in columns]
    even = F.forall(F.array(*sizes), lambda n: n == sizes[0])
    checked = records.filter(F.when(~even, F.raise_error(F.lit("columns of different lengths")).cast("boolean")).otherwise(True))
    rest = [c for c in records.columns if c not in columns]
    return checked.select(*rest, F.inline(F.arrays_zip(*columns)))


def robots_allowed(robots: Column, path: Column) -> Column:
    """Whether the rules for every agent allow a path: the longest matching rule decides, allow on ties."""
    group = F.regexp_extract(robots, r"(?is)user-agent:\s*\*\s*\n(.*?)(?:\nuser-agent:|\z)", 1)
    rules = F.filter(F.split(group, r"\n"), lambda r: r.rlike(r"(?i)^\s*(dis)?allow:\s*\S"))
    scored = F.transform(rules, lambda r: F.struct(F.length(F.regexp_extract(r, r":\s*(\S+)", 1)).alias("n"), r.rlike(r"(?i)^\s*allow").alias("ok"), F.startswith(path, F.regexp_extract(r, r":\s*(\S+)", 1)).alias("hit")))
    best = F.array_max(F.filter(scored, lambda s: s["hit"]))
    return F.coalesce(best["ok"], F.lit(True))


def absolute(href: Column, base: Column) -> Column:
    """A page's link as an address of its own site; null for others and for what is no https address."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    made = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href)).when(href.rlike("^[A-Za-z0-9._~-]"), F.concat(folder, F.lit("/"), href))
    site = lambda u: F.regexp_extract(u, r"^https?://(?:www\.)?([^/?#:]+)", 1)
    return F.when(site(made) == site(base), F.regexp_replace(F.regexp_replace(made, "#.*$", ""), "^http:", "https:"))


def next_pages(payloads: DataFrame, key: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """key and the addresses, distinct and of the same site, of links that lead to a next page."""
    found = anchors(payloads, key, body).join(payloads.select(key, url), key)
    leads = F.col("href").rlike(r"[?&](page|p|PAGEN_\d+)=\d+") | F.lower("text").isin("next", "далее", "следующая", "›", "»")
    return found.filter(leads).select(key, absolute(F.col("href"), F.col(url)).alias("next")).filter("next is not null").distinct()


#: Names of attributes that tell products apart, and of those that never do.
TELLING = r"(?iu)форма|дозиров|фасов|количеств|объ[её]м|концентрац|упаков|form|dose|pack|volume"
IDLE = r"(?iu)отзыв|рейтинг|цена|доставк|review|rating|price"


def telling_attributes(pairs: DataFrame, name: str = "name") -> DataFrame:
    return pairs.filter(F.col(name).rlike(TELLING) & ~F.col(name).rlike(IDLE))
