"""SentencePiece encoding as a max-plus parallel scan, and decoding.

The model ranks merges: of all neighbouring symbols that make a piece, those of the best piece are merged first. Merges on
one side of a place where none happened do not depend on the other side. Hence a sequence of pieces is a text's encoding
exactly if each two neighbours, taken alone, are encoded as these two. That makes the encoding a path through the lattice
of pieces whose steps score their piece, and minus infinity where two neighbours would merge otherwise; and there is one
such path.

Long texts are cut into chunks. The state at a chunk's boundary is the piece that reaches or crosses it; a chunk is a
matrix over the states at its two ends, with the score of the path from one to the other. These matrices combine
associatively in max-plus algebra, block by block, which gives every chunk the scores it is entered with. Each chunk then
maps exits to entries; composed from the text's end, these maps fix both ends of every chunk, and all chunks are
backtraced independently of one another.

Where no piece holds both of two neighbouring characters, all paths meet; between such places a run's pieces depend on the
run alone, and each distinct run is encoded once. Scores are whole numbers, so sums are exact and chunking changes nothing.
Characters without a piece become their bytes' pieces.

Defined cases: a null or empty text has no ids; texts of any length are encoded whole; repeated rows are encoded once
each; an empty table gives no rows; decoding gives back every text, with U+2581 read as a space; only the two named
columns (and `keep`) are read, so further columns may have any name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_chunks, vocabulary_file

CHUNK = 32_768
BLOCK = 256
#: Pairs of pieces that a worker remembers.
REMEMBERED = 100_000
#: Runs of more bytes go through the lattice.
SHORT_RUN = 64
#: Bytes of text whose distinct runs are encoded together.
CHUNK_BYTES = 4 << 20
#: The byte, and its token, that ends runs where they are merged together.
END = 0
SPACE = "▁"
NEVER = -(1 << 60)


#: A piece's place in a text: its first character and the one after its last.
Place = tuple[int, int]


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.bytes_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.score[piece], self.id[piece] = int(model.get_score(i)), i
                self.raw.append(piece.replace(SPACE, " ").encode("utf-8"))
        self.unknown = min(self.score.values()) - 10
        #: Score of each id; an unknown character counts once, at its first byte.
        self.id_score = np.zeros(len(self.raw), np.int64)
        self.id_score[list(self.id.values())] = [self.score[p] for p in self.id]
        self.id_score[[i for b, i in self.bytes_id.items() if not 0x80 <= b < 0xC0]] = self.unknown
        self.longest = max(map(len, self.score))
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: Prefixes of pieces: a start whose next characters are no prefix is done.
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        #: Whether runs may be cut before spaces and around line feeds; this follows from the vocabulary.
        self.splits = not any(b == SPACE and a != SPACE for a, b in self.pairs) and not any("\n" in p for p in self.pairs)
        self.fits: dict[tuple[str, str], bool] = {}
        self.merges = self.byte_merges()

    def merged(self, text: str) -> list[str]:
        """The pieces (or single unknown characters) of a short text: the best piece first, the leftmost of equals."""
        score, parts = self.score.get, list(text)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                if (s := score(parts[i] + parts[i + 1], NEVER)) > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, left: str, right: str) -> bool:
        """Whether two pieces may be neighbours; left is empty where all paths meet."""
        key = (left, right)
        if (found := self.fits.get(key)) is None:
            found = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            self.fits[key] = found
        return found

    def ends(self, text: str, i: int) -> list[int]:
        """Where the pieces that begin at i end; a character without a piece is one."""
        out = []
        for j in range(i + 1, min(i + self.longest, len(text)) + 1):
            if text[i:j] not in self.prefixes:
                break
            if text[i:j] in self.score:
                out.append(j)
        return out if out and out[0] == i + 1 else [i + 1, *out]

    def states(self, text: str, at: int) -> list[Place]:
        """The pieces that reach or cross a boundary, wherever they lie in the text given; at its start, the empty one."""
        if not at:
            return [(0, 0)]
        return [(i, j) for i in range(max(0, at - self.longest), at) for j in self.ends(text, i) if j >= at and self.together("", text[i:j])]

    def forward(self, text: str, enter: dict[Place, np.ndarray], stop: int) -> tuple[dict[Place, np.ndarray], dict[Place, Place]]:
        """Scores, one for each entry, of the pieces that paths from the entered ones take, as far as they start before `stop`; and the piece before each."""
        best, before = dict(enter), {}
        reached: dict[int, list[Place]] = {}
        for place in enter:
            reached.setdefault(place[1], []).append(place)
        for i in range(min(reached), stop):
            for j in self.ends(text, i) if i in reached else ():
                for last in reached[i]:
                    if self.together(text[last[0] : i], text[i:j]):
                        scores = best[last] + self.score.get(text[i:j], self.unknown)
                        if (i, j) in best:
                            if (scores > best[i, j]).any():
                                before[i, j] = last
                            best[i, j] = np.maximum(best[i, j], scores)
                        else:
                            best[i, j], before[i, j] = scores, last
                            reached.setdefault(j, []).append((i, j))
        return best, before

    def breaks(self, text: str, start: int, stop: int) -> tuple[int, int]:
        """First and last place within [start, stop) that no piece spans, or (-1, -1)."""
        free = lambda p: not p or text[p - 1 : p + 1] not in self.pairs
        first = next((p for p in range(start, stop) if free(p)), -1)
        return first, next((p for p in range(stop - 1, start - 1, -1) if free(p)), -1) if first >= 0 else -1

    def matrix(self, text: str, start: int, stop: int) -> np.ndarray:
        """The chunk text[start:stop] over the states at its start (rows) and at its end (columns)."""
        rows, columns = self.states(text, start), self.states(text, stop)
        unit = np.full((len(rows), len(rows)), NEVER, np.int64)
        np.fill_diagonal(unit, 0)
        entered, never = dict(zip(rows, unit)), np.full(len(rows), NEVER, np.int64)
        first, last = self.breaks(text, start, stop)
        if first < 0:
            best, _ = self.forward(text, entered, stop)
            return np.maximum(np.stack([best.get(c, never) for c in columns], axis=1), NEVER)
        best, _ = self.forward(text, entered, first)
        head = np.max([v for place, v in best.items() if place[1] == first] or [never], axis=0)
        best, _ = self.forward(text, {(last, last): np.zeros(1, np.int64)}, stop)
        tail = np.array([best[c][0] if c in best else NEVER for c in columns], np.int64)
        return np.maximum(head[:, None] + self.total(text[first:last]) + tail[None, :], NEVER)

    def between(self, text: str, start: int, stop: int, enter: int, leave: int) -> bytes:
        """Ids of the chunk text[start:stop] from after the piece of one entry to the piece of one exit."""
        enter_at, leave_at, zero = self.states(text, start)[enter], self.states(text, stop)[leave], np.zeros(1, np.int64)
        first, last = self.breaks(text, start, stop)
        if first < 0:
            return self.traced(text, self.forward(text, {enter_at: zero}, stop)[1], leave_at)
        best, before = self.forward(text, {enter_at: zero}, first)
        head = self.traced(text, before, next(place for place in best if place[1] == first))
        tail = self.traced(text, self.forward(text, {(last, last): zero}, stop)[1], leave_at)
        return b"".join([head, self.stretch(text[first:last]), tail])

    def traced(self, text: str, before: dict[Place, Place], place: Place) -> bytes:
        """Ids of the path that leads to a piece."""
        parts = []
        while place in before:
            parts.append(text[place[0] : place[1]])
            place = before[place]
        return self.ids_of(parts[::-1])

    def ids_of(self, parts: list[str]) -> bytes:
        out = array("i")
        for piece in parts:
            if (one := self.id.get(piece)) is not None:
                out.append(one)
            else:
                out.extend(self.bytes_id[b] for b in piece.encode("utf-8"))
        return out.tobytes()

    def total(self, text: str) -> int:
        """Score of the path between two places where all paths meet."""
        return int(self.id_score[np.frombuffer(self.stretch(text), "<i4")].sum())

    def run(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit bytes, of a run on its own, by the lattice: the work follows its length."""
        best, before = self.forward(text, {(0, 0): np.zeros(1, np.int64)}, len(text))
        return self.traced(text, before, next(place for place in best if place[1] == len(text) and place in before))

    def byte_merges(self):
        """The same merges over bytes, a space for U+2581: first those that make characters, then pieces, the best first.

        A token of these is one id, or, if it is not a whole character's, one id a byte; the last token ends a run.
        """
        import tiktoken

        raw = lambda text: text.replace(SPACE, " ").encode("utf-8")
        ranks = {bytes([b]): b for b in range(256)}
        for char in filter(lambda p: len(p) == 1, self.score):
            for k in range(2, len(raw(char)) + 1):
                ranks.setdefault(raw(char)[:k], len(ranks))
        for piece in sorted(self.score, key=self.score.get, reverse=True):
            if len(piece) > 1 and self.merged(piece) == [piece]:  # others are never made
                ranks[raw(piece)] = len(ranks)
        ids = {raw(p): [i] for p, i in self.id.items()}
        each = [ids.get(token, [self.bytes_id[b] for b in token]) for token in ranks]
        each[END] = []
        self.token_size = np.array([len(e) for e in each])
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_ids = np.array([i for e in each for i in e], "<i4")
        return tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def of_runs(self, runs: pa.Array) -> pa.Array:
        """The ids of each distinct run; long ones, and those with the byte that ends runs, by the lattice."""
        plain = pc.and_(pc.less_equal(pc.binary_length(runs), SHORT_RUN), pc.invert(pc.match_substring(runs, "\0")))
        lines = runs.filter(plain)
        n = len(lines)
        ids, ends = np.zeros(0, "<i4"), np.zeros(0, np.int64)
        if n:
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lines), "\0")[0].as_py() + "\0"
            tokens = np.array(self.merges.encode_ordinary(text))
            size = self.token_size[tokens]
            past = np.cumsum(size)
            within = np.arange(past[-1]) - np.repeat(past - size, size)
            ids = self.token_ids[np.repeat(self.token_at[tokens], size) + within]
            ends = past[tokens == END]
        merged = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int64)), pa.py_buffer(ids)])
        rest = pa.array([self.run(t.replace(" ", SPACE)) for t in runs.filter(pc.invert(plain)).to_pylist()], pa.large_binary())
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        at = np.where(is_plain, np.cumsum(is_plain) - 1, n + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([merged, rest]).take(pa.array(at))

    def of_stretches(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text between places where all paths meet, spaces for U+2581; each distinct run is encoded once."""
        if not any(texts):
            return [b""] * len(texts)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        fresh = np.zeros(len(buf) + 1, bool)
        fresh[bounds] = True
        if self.splits:
            space, feed = buf == 0x20, buf == 0x0A
            fresh[:-1] |= feed
            fresh[1:] |= feed
            fresh[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(fresh)
        runs = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(buf)).dictionary_encode()
        ids = self.of_runs(runs.dictionary.cast(pa.string())).take(runs.indices)
        data = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        cuts = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, bounds)].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def stretch(self, text: str) -> bytes:
        return self.of_stretches([text.replace(SPACE, " ").encode("utf-8")])[0]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts."""
        mark = SPACE.encode()
        return self.of_stretches([b" " + (t.replace(mark, b" ") if mark in t else t) if t else b"" for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; of a vector and a matrix as well."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NEVER)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "piece_bpe_32k.model", chunk: int = CHUNK, keep: Column | None = None) -> DataFrame:
    """id and ids of every row, and the column `kept` if `keep` is given."""
    path = vocabulary_file(model)
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_column).alias("row_id"), body.alias("body"), F.xxhash64(F.col(id_column), body).alias("row_key"), *([keep.alias("kept")] if keep is not None else []))
    more = ["kept"] if keep is not None else []
    long_ = F.length("body") >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch, texts in text_chunks(batches, "body", CHUNK_BYTES):
            ids = [np.frombuffer(i, "<i4") for i in words.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), id_lists(ids), *map(batch.column, more)], names=["row_id", "ids", *more])

    types = dict(keyed.dtypes)
    schema = ", ".join([f"row_id {types['row_id']}", "ids array<int>", *(f"{c} {types[c]}" for c in more)])
    short = keyed.filter(~long_).select("row_id", "body", *more).mapInArrow(whole, schema)
    giants = keyed.filter(long_)
    parts = encode_chunks(giants.select("row_key", "body"), path, chunk)
    joined = giants.join(parts, "row_key").select("row_id", "ids", *more)
    return short.union(joined).withColumnRenamed("row_id", id_column)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode_chunks(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """row_key and ids of texts (row_key, body) of `chunk` characters or more."""
    scratch = Scratch(giants.sparkSession, "pieces")
    reach = vocabulary(path).longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "body"):
            for key, text in zip(batch.column("row_key").to_pylist(), texts):
                text = prepared(text.decode("utf-8"))
                # A last chunk shorter than a piece's reach joins the one before, so that a piece crosses one boundary at most.
                starts = list(range(0, max(len(text) - reach, 1), chunk))
                for n, start in enumerate(starts):
                    end = starts[n + 1] if n + 1 < len(starts) else len(text)
                    lead = min(start, reach)
                    yield pa.RecordBatch.from_pydict({"row_key": [key], "nth": pa.array([n], pa.int32()), "lead": pa.array([lead], pa.int32()), "size": pa.array([end - start], pa.int32()), "part": [text[start - lead : end + reach - 1]]})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            made = [words.matrix(t, lead, lead + size) for t, lead, size in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "size")))]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("nth"), pa.array([len(m) for m in made], pa.int32()), pa.array([m.ravel() for m in made], pa.list_(pa.int64()))], names=["row_key", "nth", "height", "matrix"])

    chunks = scratch.keep(giants.mapInArrow(cut, "row_key long, nth int, lead int, size int, part string").dropDuplicates(["row_key", "nth"]), "chunks")
    steps = scratch.keep(chunks.mapInArrow(matrices, "row_key long, nth int, height int, matrix array<long>").withColumn("block", F.floor(F.col("nth") / BLOCK).cast("int")), "matrices")
    grid = lambda flat, height: np.array(flat, np.int64).reshape(height, -1)

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        total = None
        for flat, height in zip(rows["matrix"], rows["height"]):
            total = grid(flat, height) if total is None else combine(total, grid(flat, height))
        return pd.DataFrame({"row_key": [key[0]], "nth": [key[1]], "height": [len(total)], "matrix": [total.ravel()]})

    def entered(first: np.ndarray, rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The vector that each matrix in turn is entered with, and the matrix."""
        for flat, height in zip(rows["matrix"], rows["height"]):
            yield first, grid(flat, height)
            first = combine(first, grid(flat, height))

    def block_entries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        return pd.DataFrame({"row_key": rows["row_key"], "nth": rows["nth"], "enter": [v for v, _ in entered(np.zeros(1, np.int64), rows)]})

    def chunk_entries(rows: pd.DataFrame) -> pd.DataFrame:
        """For each exit of a chunk the entry that its path comes from, and the best exit."""
        rows = rows.sort_values("nth")
        made = list(entered(np.array(rows["enter"].iloc[0], np.int64), rows))
        return pd.DataFrame({"row_key": rows["row_key"], "nth": rows["nth"], "entries": [np.argmax(v[:, None] + m, axis=0).astype(np.int32) for v, m in made], "best": [int(np.argmax(combine(v, m))) for v, m in made]})

    blocks = steps.groupBy("row_key", "block").applyInPandas(product, "row_key long, nth int, height int, matrix array<long>")
    # A text has fewer than 2**31 characters, so at most 2**31 / (CHUNK * BLOCK) blocks.
    block_vectors = blocks.groupBy("row_key").applyInPandas(block_entries, "row_key long, nth int, enter array<long>").withColumnRenamed("nth", "block")
    maps = steps.join(block_vectors, ["row_key", "block"]).groupBy("row_key", "block").applyInPandas(chunk_entries, "row_key long, nth int, entries array<int>, best int")

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        """Both ends of every chunk, from the text's end backwards."""
        rows = rows.sort_values("nth", ascending=False)
        leave, enters, leaves = int(rows["best"].iloc[0]), [], []
        for entries in rows["entries"]:
            leaves.append(leave)
            leave = int(entries[leave])
            enters.append(leave)
        return pd.DataFrame({"row_key": rows["row_key"], "nth": rows["nth"], "enter_at": enters, "leave_at": leaves})

    fixed = maps.groupBy("row_key").applyInPandas(ends, "row_key long, nth int, enter_at int, leave_at int")

    def backtraced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(words.between(t, lead, lead + size, enter, leave), "<i4") for t, lead, size, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "size", "enter_at", "leave_at")))]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("nth"), id_lists(ids)], names=["row_key", "nth", "ids"])

    done = chunks.join(fixed, ["row_key", "nth"]).mapInArrow(backtraced, "row_key long, nth int, ids array<int>")
    return done.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("nth", "ids"))).alias("parts")).select("row_key", F.flatten("parts.ids").alias("ids"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def decode(encoded: DataFrame, ids_column: str = "ids", model: str = "piece_bpe_32k.model", out_column: str = "decoded") -> DataFrame:
    """Adds the text that the ids spell."""
    path = vocabulary_file(model)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in sliced(batches):
            column = batch.column(ids_column)
            texts = [words.decode(column[i].values.to_numpy()) if column[i].is_valid else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out_column])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*encoded.dtypes, (out_column, "string")]))
