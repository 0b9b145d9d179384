"""Sites as data: how each one's captured payloads become observations, and which connector a site gets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rating_to_five
from ..functions.urls import canonical_url, domain, listing_id
from ..operators.joins import with_fallback
from . import payloads as R

OBSERVATION = ["domain", "listing_id", "canonical_url", "product", "reviews", "rating_count", "raw_rating", "raw_rating_scale", "rating", "status"]


@dataclass(frozen=True)
class Site:
    """A site: the readers to try in order, its rating scale, and whether it can be read at all."""

    domain: str
    readers: tuple[str, ...] = ("json_ld", "microdata")
    scale: float = 5.0
    blocked: str | None = None
    only_ids: str | None = None


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"json_ld": R.json_ld, "microdata": R.microdata}


@dataclass
class Connectors:
    """Known sites; others get the generic one."""

    sites: dict[str, Site] = field(default_factory=dict)
    generic: Site = Site("*")

    def add(self, *sites: Site) -> "Connectors":
        self.sites |= {s.domain: s for s in sites}
        return self

    def of(self, name: str) -> Site:
        return self.sites.get(name, self.generic)

    def resolve(self, domains: DataFrame) -> DataFrame:
        """domain with its connector; the table of known sites is as long as the configuration."""
        known = domains.sparkSession.createDataFrame([(s.domain, "blocked" if s.blocked else "known") for s in self.sites.values()] or [("", "")], "domain string, connector string")
        return domains.join(F.broadcast(known), "domain", "left").withColumn("connector", F.coalesce("connector", F.lit("generic")))

    def collect(self, pages: DataFrame) -> DataFrame:
        """Observations of captured pages (page_id, url, html): of several products on a page the one that is bound to it, else none."""
        pages = pages.withColumn("domain", domain(F.col("url")))
        blocked = [s.domain for s in self.sites.values() if s.blocked]
        open_ = pages.filter(~F.col("domain").isin(blocked)) if blocked else pages
        found = None
        for reader in dict.fromkeys(r for s in (*self.sites.values(), self.generic) for r in s.readers):
            rows = READERS[reader](open_)
            found = rows if found is None else with_fallback(found, rows, ["page_id"], F.lit(True))
        counted = found.groupBy("page_id").agg(F.count("*").alias("n"), F.max_by(F.struct("name", "sku", "url", "rating", "best", "reviews", "ratings"), F.struct(F.col("url").isNotNull(), F.col("ratings"))).alias("p"), F.count_if(F.col("url").isNotNull()).alias("bound"))
        rows = pages.join(counted, "page_id", "left")
        clear = (F.col("n") == 1) | (F.col("bound") == 1)
        scale = F.coalesce("p.best", F.lit(5.0))
        count = F.greatest("p.reviews", "p.ratings")
        shut = F.col("domain").isin(blocked) if blocked else F.lit(False)
        status = F.when(shut, "blocked").when(F.col("n").isNull(), "not_found").when(~clear, "needs_review").when(count > 0, "ok").when(count == 0, "no_reviews").otherwise("needs_review")
        return rows.select(
            "page_id", "domain", F.coalesce("p.sku", listing_id(F.col("url"))).alias("listing_id"), canonical_url(F.col("url")).alias("canonical_url"), F.when(clear, F.col("p.name")).alias("product"),
            F.when(clear, F.col("p.reviews")).alias("reviews"), F.when(clear, F.col("p.ratings")).alias("rating_count"), F.when(clear, F.col("p.rating")).alias("raw_rating"), F.when(clear, scale).alias("raw_rating_scale"),
            F.when(clear & (count > 0), rating_to_five(F.col("p.rating"), scale)).alias("rating"), status.alias("status"),
        )


#: Sites that nothing can be read of.
STANDARD = Connectors().add(
    Site("eapteka.ru", blocked="answers with a check of the visitor"), Site("polza.ru", blocked="answers with a check of the visitor"), Site("apteka-april.ru", blocked="answers with a check of the visitor"),
    Site("ozon.ru"), Site("wildberries.ru"), Site("market.yandex.ru"), Site("megamarket.ru"), Site("irecommend.ru"), Site("otzovik.com"), Site("uteka.ru"), Site("megapteka.ru"), Site("okapteka.ru"), Site("rigla.ru"), Site("zdravcity.ru"), Site("farmlend.ru"), Site("asna.ru"), Site("apteka.ru"),
)
