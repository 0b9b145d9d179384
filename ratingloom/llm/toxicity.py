"""Toxicity by fuzzy lexicon lookup in context.

The lexicon is a short seed list and what labelled rows add: words and word beginnings that toxic documents have far
more often than others. Its trie is intersected with Levenshtein automata into one deterministic automaton, which every
word of every text walks: it accepts a term, a term one edit away (long terms only), or a word with a lexicon beginning.
Each hit is weighed in its window: quotation marks and words of report around it lower it, a person addressed raises it.
A logistic model over a document's sums gives the score.

Labels are read from two parts of the training rows, one for the lexicon and one for the model, so that the model sees
the lexicon's hits as they are on rows that did not make it. Each part is bounded by TRAIN_ROWS, and so is the lexicon;
everything else is done for every row in Spark.

Defined cases: a null or empty text has no words and is scored from its zero counts; texts are read whole; repeated rows
are scored once each; an empty table gives no rows; without labelled rows of both classes the seed list and fixed
coefficients score; rows without an id or label are never trained on; score() reads the two named columns only, and
keep_clean() carries all columns along, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, text_chunks

#: Labelled rows that each of the two fits reads at most, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: Least toxic share and rows of a candidate.
LEAST_SHARE, LEAST_ROWS = 0.01, 3
LEAST_LIFT = 4.0
#: Chance alone reaches this in about one of ten thousand candidates.
LEAST_EVIDENCE = 15.0
BEGINNINGS = range(4, 9)
#: Terms at least so long are also met one edit away.
FUZZY = 5
WINDOW = 6
PREDICT_AT = 0.7

#: Everyday insults, known before any label is read, and their weight.
SEED_TERMS = "idiot moron imbecile stupid scum trash loser pathetic worthless disgusting clown dumbass jerk freak".split()
SEED_WEIGHT = 4.0
#: Words that report or discuss speech, and words that address a person.
REPORTING = "said says quoted quote quotes word words term terms called reported wrote citation dijo dit sagte wort mot palabra".split()
ADDRESSING = "you your youre du dein dich tu toi ton vous usted eres".split()
QUOTED, AIMED = 0.3, 1.25


@dataclass
class Lexicon:
    """Terms with weights; beginnings match any word that starts so."""

    terms: dict[str, float]
    beginnings: dict[str, float]


class Automaton:
    """Levenshtein automata of the terms, intersected with their trie and made deterministic.

    `step[state, letter]` leads on, state 0 is dead and 1 the start; `weight` and `edits` tell what a state accepts.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        children: list[dict[str, int]] = [{}]
        budget, accept, open_end = [0], [None], [None]

        def put(term: str, edits: int, weight: float, ending: list) -> None:
            node = roots[edits]
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    budget.append(edits)
                    accept.append(None)
                    open_end.append(None)
                node = children[node][c]
            ending[node] = weight

        roots = {0: 0, 1: 1}
        for table, value in ((children, {}), (budget, 1), (accept, None), (open_end, None)):
            table.append(value)
        for term, weight in lexicon.terms.items():
            put(term, int(len(term) >= FUZZY), weight, accept)
        for term, weight in lexicon.beginnings.items():
            put(term, int(len(term) >= FUZZY), weight, open_end)

        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for t in (*lexicon.terms, *lexicon.beginnings) for c in t}))}
        # The node of a word whose beginning has matched: it accepts whatever follows. A beginning's last letter must be met
        # as it is, or an edit of it would let every word in that has the letters before.
        done = -1

        def closed(states: set[tuple[int, int, float]]) -> frozenset:
            """With terms' letters skipped where an edit is left."""
            todo = deque(states)
            while todo:
                node, edits, w = todo.popleft()
                if node != done and edits < budget[node]:
                    for child in children[node].values():
                        if (child, edits + 1, w) not in states:
                            states.add((child, edits + 1, w))
                            todo.append((child, edits + 1, w))
            best: dict = {}
            for node, edits, w in states:
                best[node, w] = min(best.get((node, w), 9), edits)
            return frozenset((node, e, w) for (node, w), e in best.items())

        def moved(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, edits, w in states:
                if node == done:
                    out.add((done, edits, w))
                    continue
                if c in children[node]:
                    child = children[node][c]
                    out.add((child, edits, w))
                    if open_end[child] is not None:
                        out.add((done, edits, open_end[child]))
                if edits < budget[node]:
                    out.add((node, edits + 1, w))  # a letter too many
                    out.update((child, edits + 1, w) for child in children[node].values())  # another letter
            return closed(out)

        start = closed({(roots[0], 0, 0.0), (roots[1], 0, 0.0)})
        numbers, todo = {frozenset(): 0, start: 1}, deque([start])
        rows = [[0] * (len(self.letters) + 1), None]
        while todo:
            states = todo.popleft()
            row = []
            for c in (None, *self.letters):
                target = moved(states, c)
                if target not in numbers:
                    if len(rows) == STATES:
                        raise ValueError(f"a lexicon of over {STATES} states")
                    numbers[target] = len(rows)
                    rows.append(None)
                    todo.append(target)
                row.append(numbers[target])
            rows[numbers[states]] = row
        self.step = np.array(rows, np.int32)
        self.weight = np.zeros(len(rows))
        self.edits = np.zeros(len(rows), np.int8)
        for states, n in numbers.items():
            found = [(e, -(w if node == done else accept[node])) for node, e, w in states if node == done or accept[node] is not None]
            if found:
                self.edits[n], self.weight[n] = min(found)[0], -min(found)[1]

    def classes(self, cp: np.ndarray) -> np.ndarray:
        """The letter of each code point, 0 for those that no term has."""
        known = np.array(sorted(map(ord, self.letters)) or [0], np.int64)
        number = np.array([self.letters.get(chr(c), 0) for c in known.tolist()], np.int16)
        at = np.minimum(np.searchsorted(known, np.arange(TABLE)), len(known) - 1)
        table = np.where(known[at] == np.arange(TABLE), number[at], 0).astype(np.int16)
        out = table[np.minimum(cp, TABLE - 1)]
        wide = np.flatnonzero(cp >= TABLE)
        at = np.minimum(np.searchsorted(known, cp[wide]), len(known) - 1)
        out[wide] = np.where(known[at] == cp[wide], number[at], 0)
        return out


#: States up to which an automaton is built; what every task gets of it is this times the letters.
STATES = 200_000
TABLE = 0x3000
IN_WORD = np.array([chr(i).isalnum() for i in range(TABLE)])
IS_QUOTE = np.isin(np.arange(TABLE), [ord(c) for c in "\"'“”„«»‘’‹›`"])
FEATURES = 6


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def features(texts: list[str], automaton: Automaton) -> np.ndarray:
    """A row of sums for each text."""
    lowered = [t.lower() for t in texts]
    cp, bounds = code_points(lowered)
    low = np.minimum(cp, TABLE - 1).astype(np.int64)
    inside = IN_WORD[low] | (cp >= TABLE)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(bounds, start, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts)).astype(float)
    letter = automaton.classes(cp.astype(np.int64))

    # All words walk the automaton together; the dead drop out at once.
    state, alive, k = np.ones(len(start), np.int32), np.arange(len(start)), 0
    final = np.zeros(len(start), np.int32)
    while len(alive):
        state = automaton.step[state, letter[start[alive] + k]]
        k += 1
        over = (end[alive] - start[alive] == k) & (state > 0)
        final[alive[over]] = state[over]
        go = (state > 0) & ~over
        alive, state = alive[go], state[go]
    hits = np.flatnonzero(automaton.weight[final] > 0)

    out = np.zeros((len(texts), FEATURES))
    first = np.searchsorted(owner, np.arange(len(texts)))
    last = np.searchsorted(owner, np.arange(len(texts)), "right") - 1
    quotes = np.concatenate(([0], np.cumsum(IS_QUOTE[low])))
    reporting, addressing = set(REPORTING), set(ADDRESSING)
    for h in hits.tolist():
        i = int(owner[h])
        around = range(max(h - WINDOW, int(first[i])), min(h + WINDOW, int(last[i])) + 1)
        near = {lowered[i][start[w] - bounds[i] : end[w] - bounds[i]] for w in around if w != h}
        before = quotes[start[h]] - quotes[start[around[0]]]
        after = quotes[end[around[-1]]] - quotes[end[h]]
        quoted = (before > 0 and after > 0) or bool(near & reporting)
        weight = automaton.weight[final[h]] * (QUOTED if quoted else 1.0) * (AIMED if near & addressing else 1.0)
        if automaton.edits[final[h]]:
            out[i, 1] += weight
        else:
            out[i, 0] += weight
            out[i, 2] = max(out[i, 2], weight)
        out[i, 3] += quoted
    out[:, 4] = n_words
    out[:, 5] = 1
    return out


def design(raw: np.ndarray) -> np.ndarray:
    """The model's columns: total, density and greatest weight of hits, inexact hits, quoted hits, length, constant."""
    exact, fuzzy, top, quoted, n, one = raw.T
    return np.stack([np.log1p(exact), np.log1p(100 * exact / (n + 20)), np.log1p(top), np.log1p(fuzzy), np.log1p(quoted), np.log1p(n) / 10, one], axis=1)


#: Coefficients where no labels are to be had: one plain seed hit is enough.
UNTRAINED = np.array([2.0, 0.5, 1.0, 0.5, -0.5, 0.0, -4.0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, grad)
        beta -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def terms_of(text: str) -> set[str]:
    """Distinct words, as '=word', and word beginnings, as '^begin'."""
    words = set("".join(c if c.isalnum() else " " for c in text.lower()).split()) if not text.isascii() else set(text.lower().translate(PLAIN).split())
    out = {f"={w}" for w in words if 3 <= len(w) <= 40}
    for w in words:
        out.update(f"^{w[:k]}" for k in BEGINNINGS if len(w) > k)
    return out


PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}


def count_terms(docs: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """term, n: documents that have it, of the wanted ones if given. Counted before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, "body"):
            counts: Counter = Counter()
            for t in texts:
                found = terms_of(t.decode("utf-8"))
                counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return docs.select("body").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def evidence(a: int, n_a: int, b: int, n_b: int) -> float:
    """Likelihood-ratio statistic of a term in a of n_a toxic and b of n_b other rows against one common share."""
    share = (a + b) / (n_a + n_b)
    part = lambda k, n: sum(x * math.log(x / y) for x, y in ((k, n * share), (n - k, n * (1 - share))) if x)
    return 2 * (part(a, n_a) + part(b, n_b))


def learn_lexicon(training: DataFrame) -> Lexicon:
    """From rows (body, toxic)."""
    totals = {r[0]: r[1] for r in training.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    terms, beginnings = {t: SEED_WEIGHT for t in SEED_TERMS}, {}
    if not n_toxic or not n_clean:
        return Lexicon(terms, beginnings)
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * n_toxic))
    toxic = {r[0]: r[1] for r in count_terms(training.filter("toxic = 1")).filter(F.col("n") >= least).collect()}
    clean = {r[0]: r[1] for r in count_terms(training.filter("toxic = 0"), frozenset(toxic)).collect()}
    scored = []
    for term, n in toxic.items():
        lift = (n / n_toxic) / ((clean.get(term, 0) + 0.5) / n_clean)
        if lift >= LEAST_LIFT and evidence(n, n_toxic, clean.get(term, 0), n_clean) >= LEAST_EVIDENCE:
            scored.append((-n * math.log(lift), term[0] == "^", -len(term), term, math.log(lift)))
    taken: list[str] = []
    for *_, term, weight in sorted(scored):
        body = term[1:]
        # Beginnings of one another tell the same story once; only a known beginning stands for the longer words.
        if any((t[0] == "^" and body.startswith(t[1:])) or (t[1:].startswith(body) and term[0] == "^") for t in taken):
            continue
        taken.append(term)
        (terms if term[0] == "=" else beginnings)[body] = weight
    return Lexicon(terms, beginnings)


@dataclass
class Model:
    automaton: Automaton
    beta: np.ndarray


def train(docs: DataFrame, labels: DataFrame, for_lexicon: Column, for_model: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fits on the labelled rows of two disjoint parts; the conditions are over the labels' `row_id`."""
    marked = labels.select(F.col(id_column).cast("long").alias("row_id"), F.col(label_column).cast("int").alias("toxic")).filter("row_id is not null and toxic in (0, 1)")
    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("body"))

    def part(condition: Column) -> DataFrame:
        # TRAIN_ROWS bounds what is broadcast.
        chosen = marked.filter(condition).orderBy(F.xxhash64("row_id"), "row_id", "toxic").limit(TRAIN_ROWS)
        return narrow.join(F.broadcast(chosen), "row_id")

    automaton = Automaton(learn_lexicon(part(for_lexicon)))
    rows = np.array([r[0] + [r[1]] for r in with_features(part(for_model), automaton, ["toxic"]).select("raw", "toxic").collect()], float)
    if not len(rows) or len(set(rows[:, -1])) < 2:
        return Model(automaton, UNTRAINED)
    return Model(automaton, fit(design(rows[:, :-1]), rows[:, -1]))


def with_features(rows: DataFrame, automaton: Automaton, keep: list[str]) -> DataFrame:
    types = dict(rows.dtypes)
    held = rows.sparkSession.sparkContext.broadcast(automaton)  # bounded by TRAIN_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "body"):
            raw = features([t.decode("utf-8") for t in texts], held.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(raw), pa.list_(pa.float64()))], names=[*keep, "raw"])

    return rows.select(*keep, "body").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "raw array<double>"]))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score and the counts behind it, for every row."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row_id long,score double,hit_weight double,inexact_weight double,quoted_hits double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch, texts in text_chunks(batches, "body"):
            raw = features([t.decode("utf-8") for t in texts], held.value.automaton)
            p = 1 / (1 + np.exp(-np.clip(design(raw) @ held.value.beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(p), *(pa.array(raw[:, k]) for k in (0, 1, 3))], schema=target)

    return narrow.mapInArrow(run, schema).withColumnRenamed("row_id", id_column)


def remainder(column: Column | str) -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out, 0 makes the lexicon, 2 the model."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string")) % 3


def train_in_parts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> Model:
    bound_batches(docs.sparkSession)
    return train(docs, labels, remainder("row_id") == 0, remainder("row_id") == 2, id_column)


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = PREDICT_AT) -> DataFrame:
    """The rows of docs, all their columns as they are, that score below the threshold."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text_column):
            raw = features([t.decode("utf-8") for t in texts], held.value.automaton)
            p = 1 / (1 + np.exp(-np.clip(design(raw) @ held.value.beta, -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
