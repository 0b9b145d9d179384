"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, license_scan, mixing, near_dedup, packing, periodic_runs, piece_scan, quality_rules, secret_scan, sharding, spotsigs, suffix_dedup, toxicity
from .common import Scratch, read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, Scratch(spark, "shards").root)
    store.append(read_table(spark, sf_dir, "documents"))
    store.compact()
    return sharding.placements(store)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.measure_quality(read_table(spark, sf_dir, "documents"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE_POLICY)).alias("base_failed"),
        quality_rules.passes(quality_rules.PRODUCTION_POLICY).alias("kept"),
        "fail_bits",
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_next(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A digest of the text goes along, not the text: both directions run in one stage.
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), piece_scan.SPACE, " "), 256)
    encoded = piece_scan.encode(read_table(spark, sf_dir, "documents"), keep=digest)
    round_trip = F.sha2("decoded", 256) == F.col("kept")
    return piece_scan.decode(encoded).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", round_trip.alias("round_trip"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train_in_parts(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(toxicity.remainder("doc_id") == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"), "hit_weight", "inexact_weight", "quoted_hits")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    spans, base = F.col("secret_spans"), [r.kind for r in secret_scan.RULES if r.base]
    count = lambda i: F.size(F.filter(spans, lambda s: s["rule"] == i)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(base)]
    base_text = secret_scan.span_text(F.filter(spans, lambda s: s["rule"] < len(base)))
    return found.select("doc_id", *counts, F.sha2(base_text, 256).alias("base_sha256"), secret_scan.span_text(spans).alias("spans"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.fill_in_middle(read_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    text = periodic_runs.with_repeated_tail(F.col("text"), F.coalesce(h % 10 == 0, F.lit(False)), g, 3 + g % 8)
    found = periodic_runs.find_runs(docs.select("doc_id", text.alias("text")))
    best = periodic_runs.strongest("starts", "lengths", "periods")
    rows = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(r["starts"].cast("string"), F.lit(","), r["lengths"].cast("string"), F.lit(","), r["periods"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(rows, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_spotsigs, op3_sentencepiece, op4_license_scan, op5_sharding, op6_quality_rules, op7_toxicity, op8_minhash, op9_secret_scan, op10_suffix_dedup, op11_mixing, op12_fill_in_middle, op13_periodic_runs)}

WORDS = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""WITH w AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM documents),
  g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) u(i)),
  c AS (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g),
  r AS (SELECT k, count(DISTINCT i + j) AS n FROM c, unnest([0, 1, 2]) v(j) WHERE n > 1 GROUP BY k),
  m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
    len(list_filter(ws, lambda x: regexp_full_match(x, '[\x00-\x2F:-@\x5B-\x60\x7B-\x7F]+'))) AS n_bare_words, len(regexp_extract_all(t, '!!')) AS n_exclaimed FROM w LEFT JOIN r ON r.k = w.k),
  b AS (SELECT *, CAST({" + ".join(f"CASE WHEN {test} THEN {quality_rules.BITS[name]} ELSE 0 END" for name, test in quality_rules.RULES.items())} AS BIGINT) AS fail_bits FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality_rules.BASE_POLICY.mask} <> 0 AS base_failed, fail_bits & {quality_rules.PRODUCTION_POLICY.mask} = 0 AS kept, fail_bits FROM b"""

NEAR_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents WHERE text IS NOT NULL),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) u(i) WHERE len(ws) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
  f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
  r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, f.y FROM r JOIN f ON f.x = r.reach),
  k AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
  SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id"""


def secret_sql() -> str:
    """Places follow from cutting each text at its matches, rule by rule."""
    spans = []
    for i, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        spans.append(
            f"SELECT doc_id, {i} AS rule, '{rule.kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, length(v[i]) AS least "
            f"FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS v FROM documents WHERE regexp_matches(text, '{pattern}')), unnest(range(1, len(m) + 1)) u(i) WHERE length(v[i]) >= {rule.least}"
        )
    base = [r.kind for r in secret_scan.RULES if r.base]
    text = "kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR)"
    return (
        f"WITH s AS ({' UNION ALL '.join(spans)}), g AS (SELECT doc_id, {', '.join(f'count(*) FILTER (rule = {i}) AS n_{k}' for i, k in enumerate(base))}, string_agg({text}, ',' ORDER BY a, rule) FILTER (rule < {len(base)}) AS base, string_agg({text}, ',' ORDER BY a, rule) AS spans FROM s GROUP BY 1) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"
    )


INFILL_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
  h AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
  o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

#: The others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {"op12_fill_in_middle": INFILL_SQL, "op6_quality_rules": QUALITY_SQL, "op8_minhash": NEAR_SQL, "op9_secret_scan": secret_sql()}
