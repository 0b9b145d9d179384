"""Quality rules as a bitmask ledger.

measure_quality() reads every text once and keeps its measurements and one bit for each rule that it fails. A policy is
a named, versioned set of bits: applying it, or asking what each rule adds, are bitwise operations on the ledger that
never read a text again.

Defined cases: a null or empty text has no words and fails `few_words`; texts of any length are read whole; repeated
rows give one ledger row each; an empty table gives an empty ledger; only the two named columns are read, so further
columns can have any names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Bit of each rule, and its test over the measurements. Thresholds are part of the ledger's version.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "n_letters >= 50 and 10 * n_upper > 8 * n_letters",
    "separator_words": "5 * n_bare_words > n_words",
    "exclamations": "3 * n_exclaimed > n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


#: The base policy has the two rules that every later one keeps.
POLICIES = {
    1: Policy(1, ("few_words", "repeated_words")),
    2: Policy(2, ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words")),
    3: Policy(3, tuple(RULES)),
}
BASE_POLICY, PRODUCTION_POLICY = POLICIES[1], POLICIES[3]

MEASURES = "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,n_lines long,n_letters long,n_upper long,n_bare_words long,n_exclaimed long"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B))
CONTINUATION = bytes(range(0x80, 0xC0))
WHITE_BYTES = b" \t\n\r\x0b\x0c"
PLAIN_MARKS = bytes(b for b in range(0x80) if not (chr(b).isalnum()))


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur at least twice, first ones included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, reach = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(i, reach)
            reach = i + window
    return covered


def without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def measurements(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: at ASCII white space alone
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    upper = without(text, UPPER)
    bare = sum(n for w, n in Counter(words).items() if not w.translate(None, PLAIN_MARKS))
    return (
        len(words),
        len(text) - without(text, CONTINUATION) - without(text, WHITE_BYTES),
        without(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(text, LETTERS),
        upper,
        bare,
        text.count(b"!!"),
    )


def measure_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ledger: id, every measurement, and `fail_bits`."""
    names = [part.split()[0] for part in MEASURES.split(",")]

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        columns = zip(*map(measurements, texts))
        return {"row_id": batch.column(0), **dict(zip(names, map(list, columns)))}

    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"))
    measured = map_texts(narrow, "body", f"row_id long,{MEASURES}", kernel)
    bits = sum((F.when(F.expr(test), F.lit(BITS[name])).otherwise(0) for name, test in RULES.items()), F.lit(0))
    return measured.withColumnRenamed("row_id", id_column).withColumn("fail_bits", bits.cast("long"))


def passes(policy: Policy, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that it alone rejects, and rows kept without it."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    measures = [F.count("*").alias("n_rows"), F.sum((failed == 0).cast("long")).alias("kept")]
    for rule in policy.rules:
        bit = BITS[rule]
        measures += [F.sum((failed.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"{rule}_fails"), F.sum((failed == bit).cast("long")).alias(f"{rule}_alone")]
    totals = ledger.agg(*measures)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"{r}_fails"), F.lit(0)).alias("n_failing"), F.coalesce(F.col(f"{r}_alone"), F.lit(0)).alias("n_only_this")) for r in policy.rules])
    return totals.select("n_rows", F.coalesce("kept", F.lit(0)).alias("n_kept"), F.explode(rows).alias("r")).select(F.lit(policy.version).alias("policy"), "r.rule", "n_rows", "n_kept", "r.n_failing", "r.n_only_this", (F.col("n_kept") + F.col("r.n_only_this")).alias("n_kept_without"))
