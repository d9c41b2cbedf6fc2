"""Domains, canonical URLs and source tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import let

# Tiers, their weights and members; the parts of paths that make a page tier 1. Tier 0 is satire.
WEIGHTS = {0: 0.0, 1: 1.0, 2: 0.8, 3: 0.6, 4: 0.3}
TIERS = {
    0: ["theonion.com", "fakingnews.com", "babylonbee.com", "worldnewsdailyreport.com", "empirenews.net"],
    1: ["politifact.com", "snopes.com", "factcheck.org", "fullfact.org", "altnews.in", "boomlive.in", "factly.in", "vishvasnews.com", "factchecker.in", "pib.gov.in", "afp.com", "leadstories.com"],
    2: ["reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "thehindu.com", "indianexpress.com", "ndtv.com", "ptinews.com", "hindustantimes.com", "timesofindia.indiatimes.com", "theguardian.com", "nytimes.com",
        "aljazeera.com", "economictimes.indiatimes.com", "who.int", "un.org", "isro.gov.in", "nasa.gov", "rbi.org.in", "eci.gov.in", "*.gov", "*.gov.in", "*.nic.in", "*.edu", "*.ac.in"],
    3: ["en.wikipedia.org", "wikipedia.org"],
}
TIER1_PATHS = ["apnews.com/ap-fact-check", "reuters.com/fact-check", "thequint.com/news/webqoof", "factcheck.afp.com"]


def domain_of(url: Column) -> Column:
    """The host in lower case without user, port and www."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def norm_url(url: Column) -> Column:
    """Without scheme, www, query, fragment, trailing slashes and /amp; lower case."""
    rest = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?#][\s\S]*$", ""), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(rest), r"/amp$", ""), r"^www\.", "")


def tier_table(spark: SparkSession, tiers: dict[int, list[str]] | None = None) -> DataFrame:
    """(suffix, wild, tier): a constant of some dozen rows."""
    rows = [(d.removeprefix("*."), d.startswith("*."), t) for t, own in (tiers or TIERS).items() for d in own]
    return spark.createDataFrame(rows, "suffix string, wild boolean, tier int")


def suffixes(domain: Column) -> Column:
    """A domain and its parent domains."""
    of = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return let(F.split(domain, r"\."), of)


def with_tier(df: DataFrame, url: str, tiers: dict[int, list[str]] | None = None, paths: list[str] | None = None) -> DataFrame:
    """df with domain, tier and weight. Suffixes are looked up in literal maps, so nothing is shuffled or joined.

    The path rule comes first, then tiers 0 to 3, then the default 4; a wildcard never matches its bare domain.
    """
    tiers = tiers or TIERS
    exact = F.create_map(*[x for t in sorted(tiers, reverse=True) for d in dict.fromkeys(tiers[t]) if not d.startswith("*.") for x in (F.lit(d), F.lit(t))])
    wild_pairs = [x for t in sorted(tiers, reverse=True) for d in dict.fromkeys(tiers[t]) if d.startswith("*.") for x in (F.lit(d[2:]), F.lit(t))]
    none = F.lit(None).cast("int")
    found = F.transform(suffixes(F.col("domain")), lambda s, i: F.least(F.try_element_at(exact, s), F.when(i > 0, F.try_element_at(F.create_map(*wild_pairs), s)) if wild_pairs else none))
    on_path = F.lit(False)
    for p in TIER1_PATHS if paths is None else paths:
        on_path = on_path | F.contains(F.lower(F.col(url)), F.lit(p))
    tier = F.when(F.coalesce(on_path, F.lit(False)), F.lit(1)).otherwise(F.coalesce(F.array_min(found), F.lit(4)))
    out = df.withColumn("domain", domain_of(F.col(url))).withColumn("tier", tier.cast("int"))
    weight = F.try_element_at(F.create_map(*[F.lit(x) for t, w in WEIGHTS.items() for x in (t, w)]), F.col("tier"))
    return out.withColumn("weight", weight)
