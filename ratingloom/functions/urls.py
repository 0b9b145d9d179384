"""Addresses, identities and hashes over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only tell where a visitor came from.
TRACKING = "^(utm_|yclid$|gclid$|srsltid$|at$|from$|ref)"
#: Hosts that no public page has.
PRIVATE = r"^(localhost$|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[?::1\]?$)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain(url_or_host: Column) -> Column:
    """Without scheme, www and path; the reviews host is its market's."""
    bare = F.regexp_extract(F.lower(F.trim(url_or_host)), r"^(?:[a-z]+://)?(?:www\.)?([^/?#:]+)", 1)
    return F.regexp_replace(bare, r"^reviews\.", "market.")


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_replace(p, "=.*$", "")).rlike(TRACKING))
    path = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def row_identity(domain_: Column, url: Column) -> Column:
    """One row of a report: no query, fragment, www or trailing slash."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    at = host(bare)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/]*(/.*)?$", 1), "/+$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)://", 1))
    return F.concat(F.lower(domain_), F.lit(":"), scheme, F.lit("://"), F.regexp_replace(at, r"^www\.", ""), F.when(path == "", F.lit("/")).otherwise(path))


def same_site(host_: Column, site: Column) -> Column:
    return (host_ == site) | F.endswith(host_, F.concat(F.lit("."), site))


def listing_id(url: Column) -> Column:
    """The site's own id where its addresses carry one, else twenty digits of the address's hash."""
    at = domain(url)
    by_site = (
        F.when(at == "ozon.ru", F.regexp_extract(url, r"-(\d+)/?(?:[?#].*)?$", 1))
        .when(at == "wildberries.ru", F.regexp_extract(url, r"/catalog/(\d+)", 1))
        .when(at.isin("market.yandex.ru", "yandex.ru"), F.regexp_extract(url, r"--(\d+)", 1))
        .otherwise("")
    )
    return F.when(by_site != "", by_site).otherwise(F.substring(F.sha2(url, 256), 1, 20))


def unsafe_url(url: Column) -> Column:
    """Not https, with credentials or another port, or at a private address."""
    after = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    port = F.regexp_extract(after, r":(\d+)$", 1)
    return ~url.rlike("^https://") | F.contains(after, F.lit("@")) | ((port != "") & (port != "443")) | host(url).rlike(PRIVATE)


def spreadsheet_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"^https://docs\.google\.com/spreadsheets/d/([a-zA-Z0-9_-]+)(?:/|$|[?#])", 1)
    return F.when(found != "", found)


def product_url(domain_: Column, id_: Column) -> Column:
    """The site's address for an id."""
    return (
        F.when(domain_ == "wildberries.ru", F.concat(F.lit("https://www.wildberries.ru/catalog/"), id_, F.lit("/detail.aspx")))
        .when(domain_ == "ozon.ru", F.concat(F.lit("https://www.ozon.ru/product/"), id_, F.lit("/")))
        .when(domain_ == "market.yandex.ru", F.concat(F.lit("https://market.yandex.ru/product/"), id_))
    )


def payload_hash(*columns: Column) -> Column:
    """Hash of the values in order, nulls told from empty text."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a place from 1 up to 702."""
    low = F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))
    high = F.when(n > 26, F.char(F.lit(64) + ((n - 1) / 26).cast("int"))).otherwise("")
    return F.concat(high, low)
