"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

Documents become token pieces of at most `capacity` ids. Only the histogram of piece lengths (at most `capacity` rows,
however many documents) reaches the driver. Lengths are placed longest first, each into the shortest open pack that
still has room, a whole count of equal packs at a time; what results is a table of packing patterns with counts. Each
piece then finds its place by its rank among the pieces of its length.

Ranks never need a whole length in one task: pieces of a length are dealt into as many salted groups as its count asks
for, numbered within, and shifted by the running total of the groups before, which is added up in blocks.

Defined cases: a null or empty text is one piece that holds the end id alone; longer texts are cut at every `capacity`
ids; repeated rows are packed once each; pieces of one length are told apart by id, start and checksum, and those that
agree in all three may swap places; an empty table gives no sequences; a null id is kept as null; only the two named
columns are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts, vocabulary_file, worker_model

PIECES = "row_id long,start long,length long,ids_crc32 long,doc_tokens long"
#: Pieces of one length that a task numbers at a time, and groups of them whose totals a task adds up.
RANK_GROUP, RANK_BLOCK = 128, 1024
#: Bytes of text whose distinct words are encoded together.
CHUNK_BYTES = 2 << 20


def byte_letters() -> dict[str, int]:
    """The letters that the tokenizer's file writes bytes with: printable ones stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, by their distinct words.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its words in turn. Each
    distinct word of a chunk is encoded once. A Latin letter run, with or without marks after it, is one or two runs of
    the vocabulary, which are merged by rank; a line feed stands for the end of a run, where no word has one. All other
    words go through the tokenizer itself.
    """

    LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, byte_of, ranks = {t["content"] for t in spec["added_tokens"]}, byte_letters(), {}
        for piece, i in spec["model"]["vocab"].items():
            if piece not in special:
                run = piece.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in run) + b"\n" * (run != piece)] = i
        self.ending = np.zeros(max(ranks.values()) + 1, bool)
        self.ending[[i for run, i in ranks.items() if run.endswith(b"\n")]] = True
        self.runs = tiktoken.Encoding("runs", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each word."""
        split = pc.extract_regex(words, f"^(?P<letters>[{self.LATIN}]+)(?P<marks>[{self.MARKS}]*)$")
        plain = pc.and_(split.is_valid(), pc.invert(pc.match_substring(words, "<|")))  # which may begin a special token
        letters, marks = (part.filter(plain) for part in split.flatten())
        letters, alone = pc.utf8_lower(letters), pc.equal(marks, "")
        lines = pc.if_else(alone, letters, pc.binary_join_element_wise(letters, marks, "\n"))
        n = len(lines)
        ids, ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if n:
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lines), "\n")[0].as_py() + "\n"
            ids = np.array(self.runs.encode_ordinary(text), "<u4")
            last_run = np.cumsum(2 - alone.to_numpy(zero_copy_only=False).astype(np.int64)) - 1
            ends = (np.flatnonzero(self.ending[ids]) + 1)[last_run]
        merged = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int64)), pa.py_buffer(ids)])
        others = self.whole.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)
        rest = pa.array([np.array(e.ids, "<u4").tobytes() for e in others], pa.large_binary())
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        at = np.where(is_plain, np.cumsum(is_plain) - 1, n + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([merged, rest]).take(pa.array(at))

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.values.dictionary_encode()
        ids = self.of_words(words.dictionary.cast(pa.string())).take(words.indices)
        data = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def token_pieces(docs: DataFrame, id_column: str, text_column: str, capacity: int, tokenizer_path: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Cuts each document's ids, the end id last, into pieces: row_id, start, length, ids_crc32, doc_tokens (and ids)."""
    ending = np.array([end_id], "<u4").tobytes()

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        words = worker_model(tokenizer_path, lambda: WordIds(tokenizer_path))
        out = defaultdict(list)
        for row_id, ids in zip(batch.column(0).to_pylist(), words.of_texts(texts)):
            ids += ending
            for at in range(0, len(ids), 4 * capacity):
                piece = ids[at : at + 4 * capacity]
                out["row_id"].append(row_id)
                out["start"].append(at // 4)
                out["length"].append(len(piece) // 4)
                out["ids_crc32"].append(zlib.crc32(piece))
                out["doc_tokens"].append(len(ids) // 4)
                if with_ids:
                    out["ids"].append(np.frombuffer(piece, "<u4").astype(np.int64))
        return out

    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"))
    return map_texts(narrow, "body", PIECES + ",ids array<long>" * with_ids, kernel, CHUNK_BYTES, tokenizer_path)


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many packs, [(length, how many of it), ...]), longest length first.

    Room left in a pack is the key: the pack with most room is the shortest one.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    done = []
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            widest = np.flatnonzero(rooms[length:])
            room = int(widest[-1]) + length if len(widest) else 0
            if not room:  # new packs: spread over no more than are needed to hold what is left
                packs, pattern, room = -(-left // (capacity // length)), (), capacity
            else:
                packs, pattern = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            used = min(packs, left)
            if used < packs:
                if room == capacity:
                    packs = used
                else:
                    by_room[room].append((packs - used, pattern))
                    rooms[room] = True
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern and pattern[-1][0] == length else (*pattern, (length, 1))
            left -= used
            if room - length:
                by_room[room - length].append((used, grown))
                rooms[room - length] = True
            else:
                done.append((used, grown))
    for waiting in by_room.values():
        done += waiting
    return [(n, list(pattern)) for n, pattern in done]


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks, by length: where each run begins, its packs' first number, how many a pack takes, and from which offset."""
    rows, taken, sequence = [], defaultdict(int), 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], sequence, times, offset))
            taken[length] += packs * times
            offset += length * times
        sequence += packs
    rows.sort()
    names = ("length", "rank", "sequence", "times", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def running_totals(groups: DataFrame) -> DataFrame:
    """size_key, salt and shift: the rows of the groups (size_key, salt, n) with that size and lower salts.

    Added up in blocks of salts and then over blocks, so that a length that most pieces have is no task of its own.
    """
    groups = groups.withColumn("block", F.floor(F.col("salt") / RANK_BLOCK))
    earlier = lambda window, n: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = groups.groupBy("size_key", "block").agg(F.sum("n").alias("all"))
    blocks = blocks.select("size_key", "block", earlier(Window.partitionBy("size_key").orderBy("block"), "all").alias("before"))
    within = groups.withColumn("inside", earlier(Window.partitionBy("size_key", "block").orderBy("salt"), "n"))
    return within.join(blocks, ["size_key", "block"]).select("size_key", "salt", (F.col("before") + F.col("inside")).alias("shift"))


def pack_pieces(pieces: DataFrame, capacity: int, order: list[str], length_column: str = "length") -> DataFrame:
    """Adds sequence_id and offset to every piece. `pieces` is read several times: give a written table."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length_column).count().collect()}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"piece lengths must be within 1 to {capacity}")
    slots = slot_table(packing_patterns(counts, capacity))
    spark = pieces.sparkSession
    groups = spark.createDataFrame([(k, max(1, n // RANK_GROUP)) for k, n in counts.items()], "size_key long, n_groups long")
    salted = pieces.join(F.broadcast(groups), F.col(length_column) == F.col("size_key")).withColumn("salt", F.pmod(F.xxhash64(*order), "n_groups"))
    shifts = running_totals(salted.groupBy("size_key", "salt").agg(F.count("*").alias("n")))
    within = Window.partitionBy("size_key", "salt").orderBy(*order)
    ranked = salted.withColumn("row_rank", F.row_number().over(within) - 1).join(shifts, ["size_key", "salt"]).withColumn("row_rank", F.col("row_rank") + F.col("shift")).select(*pieces.columns, "row_rank")

    # Placing is arithmetic on (length, rank) with a table bounded by the capacity.
    keys = (slots["length"] << np.int64(44)) + slots["rank"]
    kept = [c for c in pieces.columns]

    def place(batches):
        for batch in batches:
            size = batch.column(length_column).to_numpy()
            rank = batch.column("row_rank").to_numpy()
            at = np.searchsorted(keys, (size << np.int64(44)) + rank, "right") - 1
            nth = rank - slots["rank"][at]
            times = slots["times"][at]
            columns = [batch.column(c) for c in kept] + [pa.array(slots["sequence"][at] + nth // times), pa.array(slots["offset"][at] + nth % times * size)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    schema = ", ".join(f"`{n}` {t}" for n, t in [*pieces.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs: a row for each piece with its id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, id_column, text_column, capacity, vocabulary_file(tokenizer), end_id, with_ids), "pieces")
    packed = pack_pieces(pieces, capacity, ["row_id", "start", "ids_crc32"])
    return packed.withColumnRenamed("row_id", id_column)
