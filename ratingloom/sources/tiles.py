"""Listing pages as tiles, one product each, and titles that cards, reviews and addresses give.

A tile is the outermost element around a product's link that holds no other product's link: pages need not say where one
begins. Elements of many pages are columns of numbers, in which tiles are found by counting; what is read of a tile's texts is
expressions over rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import compact_count
from ..operators import identity as I
from . import elements as E
from . import markup as M

COUNTER = r"(?iu)^\(?(\d[\d\s .,]*(?:\s*(?:тыс|млн|k|к)\.?)?)\s*(?:отзыв(?:а|ов)?|оцен(?:ка|ки|ок)|reviews?|ratings?)\)?$"
SCORE = re.compile(r"[0-5](?:[.,][0-9]+)?")
#: How both begin, and what is a number as it stands.
NUMBERS, DIGITS = frozenset("(0123456789"), r"^[0-9]{1,18}$"
#: A title that a site has cut off.
CUT_OFF = r"(?:…|\.\.\.)\s*$"


def tiles(pages: DataFrame, link: str, key: str = "page_id", within: str = "body", body: str = "html") -> DataFrame:
    """A row for each tile: key, place, listing_id (group 1 of `link` in the address), href, title, reviews, rating, problem.

    Pages have their markup in `body`, or a `tree`. Tiles lie in the elements that `within` selects; links elsewhere are none.
    The longest text among the links of a tile is its title. A tile with two counters or two ratings that differ has a
    problem and neither value; so has one without a title. A product that stands in two tiles gives two rows.
    """
    whole, known_as = "tree" in pages.columns, dict(pages.dtypes)[key]
    pages, address = pages.select(key, "tree" if whole else body), re.compile(link, re.ASCII)
    M.parsed_selector(within)  # a wrong one fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch,) if whole else E.parts(batch, body):
                for elements in (E.of_column(part.column("tree")),) if whole else E.read(part.column(body)):
                    page, columns = tiles_of(elements, address, within)
                    yield pa.RecordBatch.from_arrays([part.column(key).take(page), *columns], names=[key, *COLUMNS])

    rows = pages.mapInArrow(run, f"`{key}` {known_as}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS.items()))
    told = F.filter(F.transform("labels", lambda t: F.regexp_extract(t, COUNTER, 1)), lambda t: t != "")
    counts = F.transform(told, lambda t: F.when(t.rlike(DIGITS), t.cast("long")).otherwise(compact_count(F.regexp_replace(t, r"(?<=\d)[\s ](?=\d)", ""))))
    scores = F.transform("scores", lambda t: F.replace(t, F.lit(","), F.lit(".")).cast("double"))
    rows = rows.withColumns({"_counts": counts, "_scores": scores})
    several = lambda c: F.array_max(c) != F.array_min(c)
    problem = F.when(several("_counts"), "several counters").when(several("_scores"), "several ratings").when(F.trim("title") == "", "no title")
    sole = lambda c: F.when(problem.isNull(), F.array_max(c))
    return rows.select(key, "place", "listing_id", "href", F.nullif(F.trim("title"), F.lit("")).alias("title"), sole("_counts").alias("reviews"), sole("_scores").alias("rating"), problem.alias("problem"))


#: What is found of a tile in a batch of pages; `labels` are the texts in it that begin as numbers do and are no scores.
COLUMNS = {"place": "int", "listing_id": "string", "href": "string", "title": "string", "labels": "array<string>", "scores": "array<string>"}


def tiles_of(elements: E.Elements, link: re.Pattern, within: str) -> tuple[pa.Array, list[pa.Array]]:
    """The page of each tile, and COLUMNS. All is counted along the order of elements, so its cost is that of reading them."""
    addresses, search = elements.values("href"), link.search
    products = pa.array([m[1] or "" if a is not None and t == "a" and (m := search(a)) else None for t, a in zip(elements.tags.tolist(), addresses, strict=True)], pa.string()).dictionary_encode()
    product = products.indices.fill_null(-1).to_numpy()[elements.kind]
    links = np.flatnonzero(product >= 0)
    before = np.concatenate([[0], np.cumsum(product >= 0)])
    changes = np.concatenate([[0], np.cumsum(np.diff(product[links]) != 0)])

    # Elements of the grid whose links are of one product; the outermost of them are tiles.
    placed = np.flatnonzero(elements.within(elements.select(within)))
    low, high = before[placed], before[elements.last[placed] + 1]
    placed, low, high = (x[low < high] for x in (placed, low, high))
    alone = changes[low] == changes[high - 1]
    placed, low, high = placed[alone], low[alone], high[alone]
    outermost = placed > np.concatenate([[-1], np.maximum.accumulate(elements.last[placed])[:-1]]) if len(placed) else alone[:0]
    placed, low, high = placed[outermost], low[outermost], high[outermost]

    # Texts of elements that hold no others: counters and scores stand there.
    leaves = np.flatnonzero((elements.last == np.arange(len(elements.last))) & elements.within(E.marks(len(elements.last), placed)))
    texts = elements.texts(leaves)
    shown = [i for i, t in enumerate(texts) if t[:1] in NUMBERS]
    score = np.array([texts[i][-1] in NUMBERS and SCORE.fullmatch(texts[i]) is not None for i in shown], bool)

    def listed(chosen: np.ndarray) -> pa.ListArray:
        """The chosen ones of those texts, by tile."""
        at = np.array(shown, np.int64)[chosen]
        tile = np.searchsorted(placed, leaves[at], "right") - 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(tile, minlength=len(placed)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([texts[i] for i in at.tolist()], pa.string()))

    told, hrefs = elements.texts(links), [addresses[k] for k in elements.kind[links].tolist()]
    mine = list(zip(low.tolist(), high.tolist(), strict=True))
    columns = [
        pa.array(placed - np.searchsorted(elements.page, elements.page[placed]), pa.int32()), products.dictionary.take(pa.array(product[links[low]])),
        pa.array([min(hrefs[a:b]) for a, b in mine], pa.string()), pa.array([max((len(t), t) for t in told[a:b])[1] for a, b in mine], pa.string()),
    ]
    return pa.array(elements.page[placed], pa.int64()), [*columns, listed(~score), listed(score)]


# Titles

#: Names of a card's id, of its title and of its options.
CARD_IDS, CARD_TITLES = ("nm_id", "nmId", "id"), ("imt_name", "name")
PACK_OPTION = r"(?iu)количеств|упаковк|штук"


def card_title(payload: Column, listing_id: Column, brand: Column) -> Column:
    """The title in a card's JSON if the card is this listing's and names the brand, with the pack that its options state; else null."""
    card = F.try_parse_json(payload)
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get(card, f"$.{n}", "string")), F.lit("")) for n in names])
    options = F.try_variant_get(card, "$.options", "array<variant>")
    packs = F.filter(F.transform(F.filter(options, lambda o: F.try_variant_get(o, "$.name", "string").rlike(PACK_OPTION)), lambda o: I.pack_count(F.concat(F.try_variant_get(o, "$.value", "string"), F.when(F.try_variant_get(o, "$.value", "string").rlike(r"^\s*\d+\s*$"), " шт").otherwise("")))), lambda n: n > 1)

    def whole(title: Column, name: Column) -> Column:
        stated = M.let(F.regexp_replace(title, name, F.lit(" ")), I.pack_count)
        told = M.let(F.when(stated.isNull(), F.get(packs, F.lit(0))), lambda pack: F.when(pack.isNotNull(), F.concat(title, F.lit(" №"), pack.cast("string"))).otherwise(title))
        return F.when((first(CARD_IDS) == listing_id) & ~title.rlike(CUT_OFF) & F.regexp_like(title, name), told)

    return M.let(F.struct(first(CARD_TITLES).alias("title"), I.brand_pattern(brand).alias("name")), lambda s: whole(s["title"], s["name"]))


#: Fixed value: the class under which a market shows what product a review is of.
REVIEWED_CLASS = "Review-ReasonToTrustText"
REVIEWED = r"(?iu)^(?:Товар|Product)\s*[—-]\s*(.+)$"


def reviewed_titles(tree: Column, brand: Column) -> Column:
    """Titles of the products that a page's reviews are of, as the site itself states them, each once: visible ones, then those of its state."""
    shown = F.transform(M.select(tree, f".{REVIEWED_CLASS}"), lambda n: M.text_of(tree, n))
    scripts = F.transform(M.select(tree, "script"), lambda n: n["attrs"][M.SCRIPT])
    kept = F.flatten(F.transform(F.filter(scripts, lambda s: F.contains(s, F.lit("reasonToTrust"))), lambda s: F.regexp_extract_all(s, F.lit(r'"reasonToTrust"\s*:\s*\{\s*"text"\s*:\s*("(?:\\.|[^"\\])*")'), F.lit(1))))
    texts = F.concat(shown, F.transform(kept, lambda j: M.tidy(F.try_variant_get(F.try_parse_json(j), "$", "string"))))
    titles = F.transform(F.filter(texts, lambda t: t.rlike(REVIEWED)), lambda t: F.trim(F.regexp_extract(t, REVIEWED, 1)))
    return F.array_distinct(F.filter(titles, lambda t: F.regexp_like(t, I.brand_pattern(brand))))


def of_one_form(model: Column, reviewed: Column) -> Column:
    """Whether a reviewed title may be of a model: tablets are not what comes in sachets or as powder."""
    kind = lambda t: F.when(I.dosage_form(t).startswith("таблетки"), "tablets").when(I.dosage_form(t).rlike("саше|порошок"), "powder")
    return ~F.coalesce(kind(model) != kind(reviewed), F.lit(False))


#: Words of titles and addresses that name no product.
IDLE_WORDS = ["detail", "detail.aspx", "index", "index.htm", "index.html", "отзыв", "отзывы", "review", "reviews", "цена", "купить", "инструкция", "инструкция по применению", "instruction", "описание", "аналоги", "применение"]
IDLE_WORDS += [f"{kind} {thing}" for kind, thing in (("лекарственное", "средство"), ("лекарственный", "препарат"), ("ноотропное", "средство"), ("ноотропный", "препарат"))]
NOTHING_LEFT = "Общая карточка отзывов"


def fallback_title(text: Column) -> Column:
    """What is left of a title or an address without such words and marks, its first letter large."""
    words = "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(IDLE_WORDS, key=len, reverse=True))
    left = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])", " ")
    left = M.tidy(F.regexp_replace(left, r"[|/\\,:;()\[\]{}‐‑‒–—−-]+", " "))
    return F.when(F.length(left) >= 3, F.concat(F.upper(F.substring(left, 1, 1)), F.substring(left, 2, 1_000_000))).otherwise(NOTHING_LEFT)
