"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: alternatives of trigrams that must all occur
before it can match. Postings (trigram, file) are made for the trigrams that the queries name; intersecting them gives
each file the rules that can match there, and only those run. A rule with an alternative that needs no trigram scans
every file. Matches are then placed by cutting the text at them: piece and match lengths add up to code-point offsets.

Only DataFrame functions are used. What is broadcast is the trigram queries, whose number the rules fix.

Defined cases: a null or empty text has no spans; texts are read whole; each repeated row gets its own result row; an
empty table gives no rows; only the two named columns are read, others are carried along whatever their names, but for
one named `secret_spans`, which the result replaces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length decides, and its least length; a match that falls short is dropped, not retried.
    group: int = 0
    least: int = 1
    base: bool = False


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Base rules first, in the order that ties follow. Their patterns and least lengths. Runs of one class
#: that must reach a length are matched at that length at once: no shorter run can hold a longer one.
RULES = (
    Rule("assign", "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("hex_upper", "[0-9A-F]{24,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Matches of a text that are placed together.
BLOCK = 500
GAP = "\n"  # in a literal path: anything may stand here


def literal_paths(parsed, limit: int = 64) -> list[str]:
    """Lower-case literal strings, with gaps, one of which every match follows."""
    paths = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [chr(value).lower()]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            letters = {chr(c).lower() for _, c in value}
            options = sorted(letters) if len(letters) <= 5 else [GAP]
        elif name == "SUBPATTERN":
            options = literal_paths(value[3], limit)
        elif name == "BRANCH":
            options = [p for branch in value[1] for p in literal_paths(branch, limit)]
        elif name == "MAX_REPEAT" and value[:2] == (0, 1) and len(once := literal_paths(value[2], limit)) == 1 and GAP not in once[0]:
            options = ["", *once]
        else:
            options = [GAP]
        paths = [a + b for a, b in product(paths, options)] if len(paths) * len(options) <= limit else [p + GAP for p in paths]
    return sorted(set(paths))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams that must all occur; none if some way to match needs no trigram."""
    from re import _parser

    clauses = {frozenset(part[i : i + 3] for part in path.split(GAP) for i in range(len(part) - 2)) for path in literal_paths(_parser.parse(pattern))}
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def candidates(keyed: DataFrame, rules: tuple[Rule, ...], scratch: Scratch) -> DataFrame:
    """row_key and the kinds of the indexed rules that can match there."""
    spark = keyed.sparkSession
    clauses = [(r.kind, f"{r.kind}/{i}", t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    queries = spark.createDataFrame(clauses, "kind string, clause string, trigram string, needed int")
    # Lower case is made once a text, before the trigrams are looked for; the outer explode keeps Spark from asking the
    # whole array of each text twice, in a filter of its own.
    lowered = keyed.select("row_key", F.lower("body").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted({c[2] for c in clauses})]))
    postings = scratch.keep(lowered.select("row_key", present.alias("present")).select("row_key", F.explode_outer("present").alias("trigram")).filter("trigram is not null"), "postings").distinct()
    met = postings.join(F.broadcast(queries), "trigram").groupBy("row_key", "kind", "clause").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).filter("n = needed")
    return met.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def placed(matches: Column, pieces: Column, values: Column, order: int, least: int) -> Column:
    """Spans (start, rule's place, end) of the matches whose deciding group is long enough.

    Matches are placed in blocks, each from its own beginning, and blocks are then moved to where they begin; so the work
    does not grow with the square of a text's matches.
    """
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    zipped = F.transform(F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"), values.alias("v")), lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["v"]) >= least).alias("keep")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("rule"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def moved(acc, block):
        begins = F.concat(acc["begins"], F.array(acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), begins.alias("begins"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(zipped, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    begins = lambda blocks: F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), moved, lambda acc: acc["begins"])
    shift = lambda s, by: F.struct((s["start"] + by).alias("start"), s["rule"].alias("rule"), (s["end"] + by).alias("end"))
    # A one-element transform names the blocks, which are then made once.
    spans = F.flatten(F.transform(F.array(blocks), lambda made: F.flatten(F.transform(F.arrays_zip(made.alias("made"), begins(made).alias("by")), lambda b: F.transform(b["made"]["out"], lambda s: shift(s, b["by"]))))))
    return F.when(F.size(matches) > 0, spans).otherwise(none)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs with `secret_spans`, an array of (start, rule, end) in code points, by start and rule."""
    scratch = Scratch(docs.sparkSession, "secrets")
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_column), body)
    found = candidates(docs.select(key.alias("row_key"), body.alias("body")), rules, scratch)
    keyed = docs.select(F.struct("*").alias("row"), key.alias("row_key"), body.alias("body"))
    joined = keyed.join(found, "row_key", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    columns = []
    for r in rules:
        asked = F.array_contains("kinds", r.kind) if trigram_query(r.pattern) else F.lit(True)
        columns.append(F.when(asked, F.regexp_extract_all("body", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"m_{r.kind}"))
    matched = joined.select("row", "body", *columns)
    cut = [F.when(F.size(f"m_{r.kind}") > 0, F.split("body", r.pattern, -1)).otherwise(none).alias(f"p_{r.kind}") for r in rules]
    cut += [F.when(F.size(f"m_{r.kind}") > 0, F.regexp_extract_all("body", F.lit(r.pattern), F.lit(r.group))).otherwise(none).alias(f"v_{r.kind}") for r in rules if r.group]
    pieces = matched.select("*", *cut)
    spans = [placed(F.col(f"m_{r.kind}"), F.col(f"p_{r.kind}"), F.col(f"v_{r.kind}" if r.group else f"m_{r.kind}"), i, r.least) for i, r in enumerate(rules)]
    return pieces.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "secret_spans"], F.array_sort(F.concat(*spans)).alias("secret_spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones merged, replaced by `mark`.

    A place in a text is found by counting from its beginning, so spans go by blocks: each block's stretch of the text is
    cut out once, and its spans are places in that stretch.
    """
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda i: F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)))
    ends = lambda made: F.transform(made, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    furthest = lambda ends_: F.aggregate(ends_, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))

    def cut(stretch: Column, block: Column, begin: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start, end = s["start"] - begin, s["end"] - begin
            piece = F.concat(F.substring(stretch, acc["at"] + 1, F.greatest(start - acc["at"], F.lit(0))), F.lit(mark))
            return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(start >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def whole(made: Column, begins: Column) -> Column:
        outs = F.transform(made, lambda b, i: let(F.substring(text, F.get(begins, i) + 1, F.get(begins, i + 1) - F.get(begins, i)), lambda stretch: cut(stretch, b, F.get(begins, i))))
        return F.concat(F.array_join(outs, ""), F.substring(text, F.element_at(begins, -1) + 1, F.length(text)))

    redacted = let(blocks, lambda made: let(furthest(ends(made)), lambda begins: whole(made, begins)))
    return F.when(F.size(spans) > 0, redacted).otherwise(text)
