"""Elements of a batch of pages as columns of numbers.

read() cuts the markup of many pages at once. Pages of SIMPLE markup whose elements all end by their own tags are nested by
sorting, with Python seeing each shape of a tag once; all other pages are parsed one by one, as with_tree() does. Both give
the elements of the same trees, in document order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import markup as M

TAG = re.compile(M.TAG, re.ASCII)
BAD, NOTHING, OPENS, LEAF, ENDS = range(5)
SPACES = re.compile(r"[\s\u00a0\u202f]+", re.ASCII)
WHITE, NOT_PLAIN = re.compile(r"\s+", re.ASCII), "\t\n\v\f\r\u00a0\u202f"
#: Bytes of markup that are worked on at once.
AT_ONCE = 1 << 20


class Elements:
    """Elements of several pages. Numbers of elements count through all pages.

    Elements whose tags read alike are of one kind: `tags` are the kinds' names, `values` gives an attribute's value, or
    None, of each kind. `texts` gives the tidied text of some elements, `parents` the parent of each, or -1.
    """

    def __init__(self, page: np.ndarray, last: np.ndarray, kind: np.ndarray, tags: np.ndarray, values: Callable[[str], list[str | None]], parents: Callable[[], np.ndarray], texts: Callable[[np.ndarray], list[str]]):
        self.page, self.last, self.kind, self.tags, self.values, self.parents, self.texts = page, last, kind, tags, values, parents, texts

    def passes(self, test: dict) -> np.ndarray:
        """Whether a kind passes one test of a selector, as markup.passes() has them."""
        if "tag" in test:
            return (self.tags == test["tag"].lower()) | (test["tag"] == "*")
        name = "id" if "id" in test else "class" if "cls" in test else test["name"].lower()
        holds = holding(test)
        return np.array([v is not None and holds(v) for v in self.values(name)], bool)

    def within(self, outer: np.ndarray) -> np.ndarray:
        """Whether an element is, or lies inside, one of the marked ones."""
        return np.maximum.accumulate(np.where(outer, self.last, -1)) >= np.arange(len(outer))

    def below(self, outer: np.ndarray) -> np.ndarray:
        """Whether an element lies inside one of the marked ones."""
        reach = np.maximum.accumulate(np.where(outer, self.last, -1))
        return np.concatenate([[-1], reach])[: len(outer)] >= np.arange(len(outer))

    def select(self, selector: str) -> np.ndarray:
        """Whether a selector finds an element, as markup.select() does."""
        found = np.zeros(len(self.page), bool)
        for chain in M.parsed_selector(selector):
            fits = None
            for how, tests in chain:
                here = reduce(np.logical_and, map(self.passes, tests))[self.kind]
                fits = here if fits is None else here & self.hangs(how, fits)
            found |= fits
        return found

    def hangs(self, how: str, before: np.ndarray) -> np.ndarray:
        if how == " ":
            return self.below(before)
        parents = self.parents()
        if how == ">":
            return (parents >= 0) & before[parents]
        out, marked = np.zeros(len(before), bool), np.flatnonzero(before)
        marked = marked[self.last[marked] + 1 < len(before)]
        after = self.last[marked] + 1
        out[after[(parents[after] == parents[marked]) & (self.page[after] == self.page[marked])]] = True
        return out


def holding(test: dict) -> Callable[[str], bool]:
    """The test of an attribute's value."""
    wanted, op = next((test[k] for k in ("id", "cls", "dq", "sq", "bare") if k in test), None), "=" if "id" in test else "~=" if "cls" in test else test.get("op")
    if op is None:
        return lambda v: True
    if wanted == "" and op != "=":
        return lambda v: False
    fold = str.lower if "fold" in test else str
    wanted = fold(wanted)
    holds = {"=": str.__eq__, "~=": lambda v, w: w in v and w in WHITE.split(v), "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}[op]
    return lambda v: holds(fold(v), wanted)


def tidied(texts: list[str], plain: bool) -> list[str]:
    """markup.tidy() of texts, empty if nothing is left; plain ones have no white space but spaces."""
    return [t if plain and "  " not in t else SPACES.sub(" ", t).strip(" ") for t in [t.strip(" ") for t in texts]]


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(one or other) for k, one, other in reversed(M.ATTRIBUTE.findall(text))}


def shape_of(tag: str) -> tuple[int, str, dict[str, int]]:
    """What a tag, without its brackets, does: (one of the five, name, attributes with the place of their value among what stands in double quotes)."""
    found = TAG.fullmatch(tag)
    if not found:
        return BAD, "", {}
    name, attrs, _, _, _, empty, ended = found.groups()
    if ended or not name:
        return (ENDS, ended.lower(), {}) if ended else (NOTHING, "", {})
    places: dict[str, int] = {}
    quoted = 0
    for one in M.ATTRIBUTE.finditer(attrs or ""):
        places.setdefault(one[1].lower(), quoted if one[0].endswith('"') else -1)
        quoted += one[0].endswith('"')
    return LEAF if empty or name.lower() in M.VOID else OPENS, name.lower(), places


def marks(size: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    out[at] = True
    return out


def read_plain(pages: pa.Array) -> tuple[Elements, np.ndarray]:
    """The elements of those pages that are plain throughout, and which pages are not."""
    n = len(pages)
    cut = pc.split_pattern(pc.fill_null(pages, ""), "<")
    starts = cut.offsets.to_numpy()
    pieces = cut.values.filter(pa.array(~marks(len(cut.values), starts[:-1])))
    counts = np.diff(starts) - 1
    page = np.repeat(np.arange(n), counts)
    halves = pc.split_pattern(pieces, ">", max_splits=1)
    at = halves.offsets.to_numpy()
    tags, texts = halves.values.take(pa.array(at[:-1])).dictionary_encode(), halves.values.take(pa.array(at[1:] - 1))
    code, distinct = tags.indices.to_numpy(), tags.dictionary
    # Tags that differ in quoted values alone are told once; other quotes may stand anywhere, so such tags are told as they are.
    bare = pc.replace_substring_regex(distinct, '"[^"]*"', '""')
    own = pc.or_(pc.match_substring(bare, "'"), pc.starts_with(bare, "!"))
    shapes = pc.if_else(own, distinct, bare).dictionary_encode()
    shape, own = shapes.indices.to_numpy(), own.to_numpy(zero_copy_only=False)
    told = [shape_of(t) for t in shapes.dictionary.to_pylist()]
    names: dict[str, int] = {}
    what, name = np.array([k[0] for k in told], np.int8)[shape][code], np.array([names.setdefault(k[1], len(names)) for k in told], np.int32)[shape][code]
    named = lambda wanted: np.array([t in wanted for t in names], bool)[name]

    odd = np.zeros(n, bool)
    odd[page[(what == BAD) | (np.diff(at) != 2)]] = True
    # Text of a script, a title and the like ends by its own tag alone.
    sealed = np.flatnonzero((what == OPENS) & named(M.OPAQUE))
    after = np.minimum(sealed + 1, len(what) - 1)
    odd[page[sealed[(after == sealed) | (page[after] != page[sealed]) | (what[after] != ENDS) | (name[after] != name[sealed])]]] = True
    odd[page[named(M.RAW - {"script", "style"})]] = True
    # As many ends as beginnings, and none before its beginning.
    step = (what == OPENS).astype(np.int32) - (what == ENDS)
    depth = np.cumsum(step)
    depth -= np.repeat(np.concatenate([[0], depth])[starts[:-1] - np.arange(n)], counts)
    odd[page[depth < 0]] = True
    odd |= np.bincount(page, step, n) != 0
    if odd.any():
        kept = ~odd[page]
        page, what, name, code, step, depth, texts = page[kept], what[kept], name[kept], code[kept], step[kept], depth[kept], texts.filter(pa.array(kept))
    # Of one level, beginnings and ends take turns.
    level = depth - (what == OPENS)
    turns = np.flatnonzero(step)
    turns = turns[np.argsort(level[turns].astype(np.int16) if not len(level) or level.max() < 1 << 15 else level[turns], kind="stable")]
    opens, ends = turns[0::2], turns[1::2]
    unlike = np.zeros(n, bool)
    unlike[page[opens[name[opens] != name[ends]]]] = True
    begins = (what == OPENS) | (what == LEAF)
    # What may be closed by another's start is left to the parser.
    step[unlike[page]] = 0
    for closed in set().union(*M.CLOSES.values()) & names.keys():
        open_ = np.where(name == names[closed], step, 0)
        unlike[page[begins & named({t for t, closes in M.CLOSES.items() if closed in closes}) & (np.cumsum(open_) - np.maximum(open_, 0) > 0)]] = True
    tokens = np.flatnonzero(begins & ~unlike[page])
    number = np.cumsum(marks(len(page), tokens)) - 1
    ending = np.arange(len(page))
    ending[opens] = ends
    ended, last = ending[tokens], number[ending[tokens]]

    def values(wanted: str) -> list[str | None]:
        out = np.full(len(distinct), None, object)
        for i, (_, _, places) in enumerate(told):
            if wanted in places:
                kinds = np.flatnonzero(shape == i)
                alike = distinct.take(pa.array(kinds))
                if own[kinds[0]]:
                    found = [attributes(TAG.fullmatch(alike[0].as_py())[2])[wanted]]
                elif places[wanted] < 0:
                    found = [""] * len(kinds)
                else:
                    found = pc.list_element(pc.split_pattern(alike, '"'), 2 * places[wanted] + 1).to_numpy(zero_copy_only=False)
                out[kinds] = [unescape(v) for v in found] if not own[kinds[0]] and any("&" in v for v in found) else found
        return out.tolist()

    def parents() -> np.ndarray:
        """The latest beginning one level up."""
        size = len(page) + 1
        key = (level[tokens].astype(np.int64) - 1) * size + tokens
        up = np.searchsorted(level[opens].astype(np.int64) * size + opens, key) - 1
        return np.where(level[tokens] > 0, number[opens[up]], -1) if len(opens) else np.full(len(tokens), -1)

    # The pages' text, in which an element's is what stands from its own tag up to its end.
    silent, spaced = named({"script", "style"}) & (what == OPENS), ~named(M.INLINE) & (what != NOTHING)
    referring = np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False) & ~silent)
    if len(referring):
        said = texts.to_pylist()
        for i in referring.tolist():
            said[i] = unescape(said[i])
        texts = pa.array(said, pa.string())
    texts = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), pc.if_else(pa.array(silent), "", texts), "")
    whole, shift = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py(), np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())])
    plain = not any(c in whole for c in NOT_PLAIN)

    def texts_of(elements: np.ndarray) -> list[str]:
        return tidied([whole[a:b] for a, b in zip(shift[tokens[elements]].tolist(), shift[ended[elements]].tolist(), strict=True)], plain)

    return Elements(page[tokens], last, code[tokens], np.array([k[1] for k in told], object)[shape], values, parents, texts_of), odd | unlike


def of_trees(trees: list[tuple[str, list]], pages: np.ndarray) -> Elements:
    """The elements of trees, each (text, nodes), of the given pages."""
    shift = np.cumsum([0, *(len(nodes) for _, nodes in trees)])
    owner = np.repeat(np.arange(len(trees)), np.diff(shift))
    nodes = [n for _, page in trees for n in page]
    column = lambda i: np.array([n[i] for n in nodes], np.int64)
    base = shift[owner]
    parents = lambda: np.where(column(2) >= 0, column(2) + base, -1)
    texts = lambda elements: tidied([trees[owner[e]][0][nodes[e][5] : nodes[e][6]] for e in elements.tolist()], False)
    return Elements(pages[owner], column(1) + base, np.arange(len(nodes)), np.array([n[3] for n in nodes], object), lambda wanted: [n[4].get(wanted) for n in nodes], parents, texts)


def of_column(trees: pa.StructArray) -> Elements:
    """The elements of trees as with_tree() gives them."""
    pages = [(t["text"], [[*n.values()] for n in t["nodes"]]) if t else ("", []) for t in trees.to_pylist(maps_as_pydicts="lossy")]
    return of_trees(pages, np.arange(len(pages)))


def read(pages: pa.Array) -> Iterator[Elements]:
    """The elements of all pages, those of plain ones first."""
    plain, odd = read_plain(pages)
    yield plain
    if odd.any():
        others = np.flatnonzero(odd)
        parsed = [M.parsed(pages[int(i)].as_py()) for i in others]
        yield of_trees([("".join(t.text), t.nodes) for t in parsed], others)


def parts(batch: pa.RecordBatch, body: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some AT_ONCE bytes of markup each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy())
    ends = np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1
    for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)
