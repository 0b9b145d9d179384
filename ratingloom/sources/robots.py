"""robots.txt: groups of agents, the longest matching rule, delays and sitemaps, as expressions over a file's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPS = "struct<agents:array<string>,ruled:boolean,rules:array<struct<agent:string,field:string,value:string>>>"


def rules_of(text: Column) -> Column:
    """(agent, field, value) of every rule: agents named in a row share the rules that follow; comments and lines without a colon do not count."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", ""))), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(lines, lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value")))

    def step(state: Column, line: Column) -> Column:
        agent = line["field"] == "user-agent"
        agents = F.when(agent & state["ruled"], F.array(F.lower(line["value"]))).when(agent, F.concat(state["agents"], F.array(F.lower(line["value"])))).otherwise(state["agents"])
        made = F.transform(state["agents"], lambda a: F.struct(a.alias("agent"), line["field"].alias("field"), line["value"].alias("value")))
        rules = F.when(agent, state["rules"]).otherwise(F.concat(state["rules"], made))
        return F.struct(agents.alias("agents"), (~agent).alias("ruled"), rules.alias("rules")).cast(GROUPS)

    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"), F.array().cast("array<struct<agent:string,field:string,value:string>>").alias("rules")).cast(GROUPS)
    return F.coalesce(F.aggregate(pairs, start, step)["rules"], start["rules"])


def for_agent(rules: Column, agent: str) -> Column:
    """The rules for an agent: those of groups that name it, else those for all."""
    own = F.filter(rules, lambda r: (r["agent"] != "*") & F.contains(F.lit(agent.lower()), r["agent"]) & (r["agent"] != ""))
    return F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: r["agent"] == "*"))


def allowed(rules: Column, path: Column) -> Column:
    """Whether rules allow a path: the longest rule that matches decides, allow on ties; * stands for anything, $ for the end."""
    ways = F.filter(rules, lambda r: r["field"].isin("allow", "disallow") & (r["value"] != ""))
    quoted = lambda v: F.regexp_replace(F.regexp_replace(v, r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*")
    pattern = lambda v: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted(v), r"\$(?=.)", r"\\\$"), r"(?<!\\)\$$", "\\$"))
    hits = F.filter(F.transform(ways, lambda r: F.struct(F.length(r["value"]).alias("n"), (r["field"] == "allow").alias("ok"), F.regexp_like(path, pattern(r["value"])).alias("hit"))), lambda s: s["hit"])
    return F.coalesce(F.array_max(hits)["ok"], F.lit(True))


def crawl_delay(rules: Column) -> Column:
    """Seconds between requests, the longest that is asked for; null if none is."""
    return F.array_max(F.transform(F.filter(rules, lambda r: (r["field"] == "crawl-delay") & r["value"].rlike(r"^\d+([.]\d+)?$")), lambda r: r["value"].cast("double")))


def sitemaps(text: Column) -> Column:
    """Addresses of sitemaps, wherever they stand."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1)))
