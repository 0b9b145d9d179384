"""Fill-in-the-middle: documents cut at two ranks of code points and their parts put in another order between sentinels.

Texts stay UTF-8 and are never cut open letter by letter. One Aho-Corasick automaton runs over them and reports sparse
events: places where the width of the code points changes, which happens where an ASCII character meets another one (or
where wide ones of two widths meet), and the sentinels. Between two events all code points have one width, so a gap's
bytes divided by that width are its code points, and the rank of a place, or the place of a rank, is found by a search
among the events. A text without events is one division.

Every document is worked on alone, so nothing is shuffled; its draws come from a hash of its id, so reruns agree.

Defined cases: a null text is empty; empty texts, and texts that contain a sentinel, stay plain; texts of any length are
worked on whole; rows that repeat give equal rows, one each; a null id draws like an id of no digits; an empty table
gives an empty table; only the two named columns are read, so further columns can have any names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .hashing import joined

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are cut, and of 100 that are cut so many have the suffix in front.
CUT_RATE, SUFFIX_FIRST_RATE = 90, 20
#: Symbols of the automaton besides the letters of sentinels: other ASCII, continuations, and the first byte of each width.
OTHER, INNER, FIRST = 0x01, 0x80, {2: 0xC2, 3: 0xE0, 4: 0xF0}
SENTINEL = 7
SCHEMA = "row_id long,n long,form string,prefix_chars long,middle_chars long,output string"


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


class EventScan:
    """The automaton of changes of width and of sentinels, and what follows from its events."""

    def __init__(self, sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)):
        for s in sentinels:
            if not s.isascii() or not s.isprintable() or any(s[:k] == t[-k:] for t in sentinels for k in range(1, min(len(s), len(t)) + (s != t))) or any(s in t for t in sentinels if t != s):
                raise ValueError(f"sentinels are printable ASCII and never overlap: {s}")
        self.sentinels = sentinels
        letters = sorted({ord(c) for s in sentinels for c in s})
        symbols = np.full(256, INNER, np.uint8)
        symbols[:0x80] = OTHER
        symbols[letters] = letters
        symbols[0xC0:0xE0], symbols[0xE0:0xF0], symbols[0xF0:] = FIRST[2], FIRST[3], FIRST[4]
        self.symbols = symbols.tobytes()
        self.width = np.ones(256, np.int64)
        self.width[0xC0:0xE0], self.width[0xE0:0xF0], self.width[0xF0:] = 2, 3, 4
        self.automaton = ahocorasick.Automaton()
        add = lambda codes, value: self.automaton.add_word("".join(map(chr, codes)), value)
        for a in (OTHER, *letters):
            add((INNER, a), 1)
            for width, first in FIRST.items():
                add((a, first), width)
        for width, first in FIRST.items():
            for other, then in FIRST.items():
                if other != width:
                    add((first, *[INNER] * (width - 1), then), other)
        for i, s in enumerate(sentinels):
            add(map(ord, s), SENTINEL + i)
        self.automaton.make_automaton()

    def events(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Last byte and kind of every event: a width from that byte on, or SENTINEL and more for the end of a sentinel."""
        found = np.fromiter((end << 4 | kind for end, kind in self.automaton.iter(data.translate(self.symbols).decode("latin-1"))), np.int64)
        return found >> 4, found & 15


class Ranks:
    """Ranks of code points in texts that stand one after the other in a buffer."""

    def __init__(self, scan: EventScan, texts: list[bytes]):
        self.buf, bounds = joined(texts)
        self.start, self.end = bounds[:-1], bounds[1:] - 1
        at, kind = scan.events(self.buf.tobytes())
        self.sentinel_end, self.sentinel = at[kind >= SENTINEL] + 1, kind[kind >= SENTINEL] - SENTINEL
        # Texts begin as the line feed before them ends, so a text that begins wide is an event of its own.
        at, kind = np.concatenate((self.start[:1], at[kind < SENTINEL])), np.concatenate((scan.width[self.buf[:1]], kind[kind < SENTINEL]))
        self.at, self.each = at, kind
        self.before = np.concatenate(([0], np.cumsum(np.diff(at) // kind[:-1]))) if len(at) else at

    def rank(self, place: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.at, place, "right") - 1
        return self.before[run] + (place - self.at[run]) // self.each[run]

    def place(self, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, rank, "right") - 1
        return self.at[run] + (rank - self.before[run]) * self.each[run]

    def has_sentinel(self) -> np.ndarray:
        return np.searchsorted(self.sentinel_end, self.end, "right") > np.searchsorted(self.sentinel_end, self.start, "right")


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, cut_rate: int = CUT_RATE, suffix_first_rate: int = SUFFIX_FIRST_RATE, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """For each document its id, n code points, form (plain, psm or spm), prefix_chars and middle_chars (null if plain), and the output text."""
    EventScan(sentinels)  # what is wrong with them is told now
    prefix, suffix, middle = (s.encode() for s in sentinels)
    made: list[EventScan] = []

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        if not made:
            made.append(EventScan(sentinels))
        ranks = Ranks(made[0], texts)
        first = ranks.rank(ranks.start)
        n = ranks.rank(ranks.end) - first
        h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
        low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
        plain = (n == 0) | ranks.has_sentinel() | (h3 % 100 >= cut_rate)
        suffix_first = h4 % 100 < suffix_first_rate
        begin, cut, again = (np.asarray(p).tolist() for p in (ranks.start, ranks.place(first + low), ranks.place(first + high)))
        outputs = []
        for i, text in enumerate(texts):
            if plain[i]:
                outputs.append(text)
                continue
            a, b = cut[i] - begin[i], again[i] - begin[i]
            if suffix_first[i]:
                outputs.append(b"".join((suffix, text[b:], prefix, text[:a], middle, text[a:b])))
            else:
                outputs.append(b"".join((prefix, text[:a], suffix, text[b:], middle, text[a:b])))
        form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
        return {"row_id": batch.column(0), "n": n, "form": pa.array(form.tolist(), pa.string()), "prefix_chars": pa.array(low, mask=plain), "middle_chars": pa.array(high - low, mask=plain), "output": pa.array(outputs, pa.string())}

    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"), *draws(F.col(id_column), seed))
    return map_texts(narrow, "body", SCHEMA, kernel).withColumnRenamed("row_id", id_column)


def restore(cut: DataFrame, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """The rows of fill_in_middle() with the column `restored`: the text, from output and form alone."""
    made: list[EventScan] = []
    # The sentinels in the order that each form has them, and which of their three parts come first, second and third.
    orders = {"psm": ((0, 1, 2), (0, 2, 1)), "spm": ((1, 0, 2), (1, 2, 0))}

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        if not made:
            made.append(EventScan(sentinels))
        ranks = Ranks(made[0], texts)
        first = np.searchsorted(ranks.sentinel_end, ranks.start, "right")
        out = []
        for i, (form, text) in enumerate(zip(batch.column("form").to_pylist(), texts)):
            if form == "plain":
                out.append(text)
                continue
            expected, parts = orders[form]
            here = slice(first[i], first[i] + 3)
            ends = (ranks.sentinel_end[here] - ranks.start[i]).tolist()
            if tuple(ranks.sentinel[here]) != expected or ends[0] != len(sentinels[expected[0]]) or ends[2] > len(text):
                raise ValueError(f"output of form {form} without its sentinels")
            stops = [ends[k] - len(sentinels[expected[k]]) for k in (1, 2)] + [len(text)]
            pieces = [text[a:b] for a, b in zip(ends, stops)]
            out.append(b"".join(pieces[k] for k in parts))
        return {**{name: batch.column(name) for name in batch.schema.names}, "restored": pa.array(out, pa.string())}

    kinds = {"bigint": "long"}
    schema = ",".join(f"{n} {kinds.get(t, t)}" for n, t in [*cut.dtypes, ("restored", "string")])
    return map_texts(cut, "output", schema, kernel)
