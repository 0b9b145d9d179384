"""Projections and predicates over observations, titles and messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sites by section of the report.
MARKETPLACES = ("ozon.ru", "wildberries.ru", "market.yandex.ru", "yandex.ru", "megamarket.ru")
PHARMACIES = ("uteka.ru", "megapteka.ru", "medum.ru", "eapteka.ru", "polza.ru", "asna.ru", "farmlend.ru", "okapteka.ru", "rigla.ru", "zdravcity.ru", "apteka.ru", "nfapteka.ru", "budzdorov.ru", "etabl.ru", "apteka-april.ru")
PHARMACY_NAME = r"(^|[.-])(apteka|pharm|farm|zdrav|drugstore)([.-]|$)"


def category(domain: Column) -> Column:
    """Section of a site; one that is no known shop is a place of reviews. A reviews host stands for its market."""
    return F.when(domain.isin(*MARKETPLACES), "marketplaces").when(domain.isin(*PHARMACIES) | domain.rlike(PHARMACY_NAME), "pharmacies").otherwise("review-sites")


def expanded(text: Column, words: dict[str, str]) -> Column:
    for short, long_ in words.items():
        text = F.replace(text, F.lit(short), F.lit(long_))
    return text


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def tags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in patterns.items()]))


def matches_any(title: Column, aliases: list[str]) -> Column:
    """Whether one of the (normalised) aliases stands in the (normalised) title as whole words."""
    padded = F.concat(F.lit(" "), title, F.lit(" "))
    out = F.lit(False)
    for alias in aliases:
        out = out | F.contains(padded, F.lit(f" {alias} "))
    return out


def names_exactly(text: Column, brand: str) -> Column:
    """Whether the brand stands there as asked for; dashes and spaces inside it may vary."""
    parts = [re.escape(p) for p in re.split(r"[\s‐‑‒–—−-]+", brand.strip()) if p]
    return text.rlike(r"(?iu)(^|[^\p{L}\p{N}])" + r"[\s‐‑‒–—−-]*".join(parts) + r"($|[^\p{L}\p{N}])")


def search(rows: DataFrame, columns: list[str], asked: str) -> DataFrame:
    """Rows whose columns, joined, hold the text; case and ё do not matter."""
    plain = lambda c: F.replace(F.lower(c), F.lit("ё"), F.lit("е"))
    return rows.filter(F.contains(plain(F.concat_ws(" ", *columns)), plain(F.lit(asked))))


def unify_feedback(rows: DataFrame) -> DataFrame:
    """One feedback count from written reviews and ratings: their maximum, never their sum.

    Reads reviews, rating_count, rating, status, written_review_count and its presence flag. Only rows that were read
    take part; what was written stays on record once another counter is known, and a count of zero has no rating.
    """
    takes_part = F.col("status").isin("ok", "no_reviews", "needs_review") & (F.col("reviews").isNotNull() | F.col("rating_count").isNotNull())
    count = F.greatest("reviews", "rating_count")
    records = takes_part & F.col("rating_count").isNotNull() & ~F.col("has_written_review_count")
    status = F.when((count > 0) & (F.col("status") == "no_reviews"), "ok").when((count <= 0) & (F.col("status") == "ok"), "no_reviews").otherwise(F.col("status"))
    changed = {
        "written_review_count": F.when(records, F.col("reviews")).otherwise(F.col("written_review_count")),
        "has_written_review_count": F.col("has_written_review_count") | records,
        "reviews": F.when(takes_part, count).otherwise(F.col("reviews")),
        "rating": F.when(takes_part & (count <= 0), None).otherwise(F.col("rating")),
        "status": F.when(takes_part, status).otherwise(F.col("status")),
    }
    return rows.withColumns(changed)


def first_case(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


#: Words of messages about an exhausted quota (together; in one sentence), about a block, and answers that are blocks.
QUOTA, QUOTA_APART = ["quota exceeded", "limit exceeded", "квот"], [("лимит", "исчерпан"), ("лимит", "превышен")]
BLOCKED = ["captcha", "капч", "заблокирован", "блокирует", "access denied", "forbidden"]
BLOCKED_STATUS = (401, 403, 408, 425, 429, 498, 499)


def error_kind(message: Column) -> Column:
    """What a message tells of a failed collection."""
    status = F.try_to_number(F.nullif(F.regexp_extract(message, r"(?i)\bHTTP\s+(\d{3})\b", 1), F.lit("")), F.lit("999")).cast("int")
    plain = F.regexp_replace(F.lower(message), r"\s+", " ")
    quota, blocked = F.lit(False), plain.rlike(r"^ ?blocked ?:") | F.coalesce(status.isin(*BLOCKED_STATUS) | status.between(500, 599), F.lit(False))
    together = F.regexp_replace(plain, r"[\s_-]+", "")
    for words in QUOTA:
        quota = quota | F.contains(together, F.lit(words.replace(" ", "")))
    for first, then in QUOTA_APART:
        quota = quota | F.exists(F.split(plain, r"\."), lambda sentence: sentence.rlike(f"{first}.{{0,80}}{then}"))  # noqa: B023
    for words in BLOCKED:
        blocked = blocked | F.contains(plain, F.lit(words))
    return F.when(message.isNull(), "error").when(quota, "quota_exceeded").when(blocked, "blocked").otherwise("parser_changed")


def narrow(rows: DataFrame, key: str, fits: Column) -> DataFrame:
    """Of a key's candidates, if there are several and some fit, only those."""
    seen = rows.groupBy(key).agg(F.count("*").alias("_n"), F.bool_or(fits).alias("_any"))
    return rows.join(seen, key).filter((F.col("_n") == 1) | ~F.col("_any") | fits).drop("_n", "_any")


def accepts_itself(rows: DataFrame) -> Column:
    """A listing whose own page proves its counters needs no person: read, identified exactly, with an identifier of its site."""
    proven = F.exists("identifiers", lambda i: i["type"].isin("sku", "listing"))
    return (F.col("status").isin("ok", "no_reviews")) & (F.col("granularity") == "variant") & (F.col("confidence") == "exact") & proven


#: Words that a title of any shared rating may have.
GENERIC_WORDS = ("отзыв", "отзывы", "цена", "цены", "инструкция", "аналоги", "препарат", "средство", "купить", "рейтинг")


def collapses_pages(brand: Column, product: Column) -> Column:
    """Whether a shared rating stands for pages that differ: several were discovered, none is told exactly, and the (normalised) title has words of its own."""
    shared = F.col("granularity").isin("family", "line") & (F.col("confidence") != "exact") & (F.coalesce("variant_count", F.lit(0)) <= 1) & F.col("family") & (F.size("variants") <= 0)
    own = F.array_except(F.array_remove(F.split(product, " "), ""), F.concat(F.split(brand, " "), F.array(*map(F.lit, GENERIC_WORDS))))
    return (F.col("discovered") > 1) & shared & (F.size(own) > 0)


def title_evidence(title: Column, kind: Column, id_: Column, url: Column) -> Column:
    """What a listing's title alone proves: scope, signals (title, and the address if there is one) and its identifier."""
    signal = lambda source, text: F.struct(F.lit(source).alias("source"), text.alias("text"))
    signals = F.filter(F.array(signal("title", F.trim(F.regexp_replace(title, r"\s+", " "))), signal("url", url)), lambda s: s["text"].isNotNull())
    return F.struct(F.lit("listing").alias("scope"), signals.alias("signals"), F.array(F.struct(kind.alias("type"), id_.alias("value"))).alias("identifiers"))


def status_after_identity(status: Column, granularity: Column) -> Column:
    """A listing that is no product goes; one that cannot be told apart waits for a person."""
    return F.when(granularity == "not_product", "not_found").when((status == "ok") & (granularity == "unresolved"), "needs_review").otherwise(status)


def settle_not_found(rows: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """Listings that were not found: known ones stay as history with empty metrics, those said to be gone go, the rest wait."""
    known = registry.select(*key).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, key, "left")
    lost = F.col("status") == "not_found"
    historical = lost & F.coalesce("_known", F.lit(False))
    kept = joined.filter(~(lost & ~historical & F.col("explicitly_missing")))
    return kept.withColumns({
        "reviews": F.when(historical, None).otherwise(F.col("reviews")),
        "historical": historical,
        "status": F.when(lost & ~historical, "needs_review").otherwise(F.col("status")),
    }).drop("_known")


def a_person_can_confirm(status: Column, reviews: Column, problem: Column) -> Column:
    return (status == "needs_review") & reviews.isNotNull() & (reviews >= 0) & ~F.coalesce(problem.isin("blocked", "quota_exceeded", "parser_changed"), F.lit(False))


def ready_to_publish(rows: DataFrame, group: str) -> DataFrame:
    """For each group: cards read, cards that wait, and whether it may be published."""
    read = F.count_if(F.col("status").isin("ok", "no_reviews", "not_found"))
    waits = F.count_if(F.col("status") == "needs_review")
    return rows.groupBy(group).agg(read.alias("read"), waits.alias("waiting"), (F.count("*") == read).alias("ready"))
