"""Which way a collector's evidence says it went, and how it was read: from its words, never from the site's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import walk
from .projections import tags

SEP = r"[-_\s]?"


def phrase(*words: str) -> str:
    return "(" + "|".join(w.replace("-", SEP) for w in words) + ")"


def word(*words: str) -> str:
    return r"\b" + phrase(*words) + r"\b"


#: Channels and parsers by the words that prove them, and channels that yield to others.
CHANNELS = {
    "yandex_translate": phrase("yandex-translate", "translate[.]yandex", "turbopages"), "google_translate": phrase("google-translate", "translate[.]goog", "translated"),
    "reader_proxy": phrase("reader-proxy", "static-reader") + "|" + word("reader"), "gateway": phrase("fixed-proxy", "proxy-gateway") + "|" + word("gateway"), "sandbox": phrase("edgeone-browser", "sandbox"), "browser": phrase("edgeone-browser", "sandbox") + "|" + word("browser"),
    "registry": phrase("historical-registry", "previous-registry") + "|" + word("registry"), "first_party_api": phrase("first-party-api", "first-party-json", "composer-api", r"card-v\d+", "search-json"), "direct": word("direct") + "|" + phrase("first-party", "site-search", "data-layer", "initial-state", "next-data"),
}
YIELDS = {"google_translate": ["yandex_translate"], "direct": ["google_translate", "yandex_translate", "reader_proxy", "gateway", "sandbox", "browser", "registry"]}
PARSERS = {"json_ld": phrase("json-ld", "aggregate-rating"), "dom": phrase("microdata", "category-summary") + "|" + word("visible", "dom"), "embedded_state": phrase("data-layer", "initial-state", "next-data", "embedded-state", "reviewinfo"), "api_json": phrase("composer-api", r"card-v\d+", "search-json", "api-json")}
#: Levels of evidence that are read.
LEVELS = 5


def runtime_signals(evidence: DataFrame, key: str, body: str) -> DataFrame:
    """key, channels and parsers that the names and texts of a JSON evidence prove; evidence that is no JSON is one text."""
    told = walk(evidence, key, body).filter(F.col("depth") <= LEVELS)
    words = told.select(key, F.concat_ws(" ", "name", F.when(F.col("kind") == "string", F.col("value"))).alias("w"))
    texts = words.groupBy(key).agg(F.lower(F.array_join(F.array_sort(F.collect_list("w")), " ")).alias("t"))
    plain = evidence.filter(F.try_parse_json(body).isNull()).select(key, F.lower(F.coalesce(F.col(body), F.lit(""))).alias("t"))
    found = texts.unionByName(plain)
    found = found.withColumn("_all", tags(F.col("t"), CHANNELS))
    kept = F.col("_all")
    for name, others in YIELDS.items():
        kept = F.when(F.arrays_overlap("_all", F.array(*map(F.lit, others))), F.array_remove(kept, name)).otherwise(kept)
    return found.select(key, kept.alias("channels"), tags(F.col("t"), PARSERS).alias("parsers"))
