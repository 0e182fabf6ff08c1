"""Candidate sources: scoring, de-duplication, limits per host or source, name matching, grounding of claims."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..functions.text import BLANK
from ..functions import clean, host_authority, host_of, normalise_url
from ..session import write_stage
from .ordering import first_per_group


def source_registry(spark: SparkSession) -> DataFrame:
    rows = [(n, u, k, a, int(p), [c.strip() for c in cats.split(",")])
            for n, u, k, a, p, cats in fixed.table(fixed.SOURCE_REGISTRY)]
    return spark.createDataFrame(rows, "name string, url string, kind string, access string, priority int, categories array<string>")


def tiered_sources(spark: SparkSession) -> DataFrame:
    rows = [(i, int(tier), name, [t.strip() for t in topics.split(",") if t.strip()])
            for i, (tier, name, topics) in enumerate(fixed.table(fixed.TIERED_SOURCES))]
    return spark.createDataFrame(rows, "place int, tier int, name string, topics array<string>")


def registry_candidates(registry: DataFrame) -> DataFrame:
    """Registry rows as candidates with their quality dimensions."""
    access = F.col("access")
    return registry.select(
        F.concat(F.lit("registry_"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")).alias("candidate_id"), "name", "url",
        access.isin("api", "download").alias("machine_readable"),
        F.greatest(F.lit(0.1), F.lit(1.0) - F.col("priority") / F.lit(12.0)).alias("authority"),
        F.when(access == "api", F.lit(0.9)).when(access == "download", F.lit(0.75)).otherwise(F.lit(0.3)).alias("directness"),
        F.when(F.array_contains("categories", "global"), F.lit(0.9)).otherwise(F.lit(0.6)).alias("coverage"),
        F.lit(0.7).alias("methodology"), F.lit(0.7).alias("recency"), F.lit(0.7).alias("consistency"))


def sources_for_topics(sources: DataFrame, topics: list[str]) -> DataFrame:
    """Sources of a topic class: tier first, then shared topics. Tiers 1 and 2 are always in."""
    hits = F.size(F.array_intersect("topics", F.array(*[F.lit(t) for t in topics]).cast("array<string>")))
    return (sources.withColumn("hits", hits).filter((F.col("hits") > 0) | (F.col("tier") <= 2))
            .orderBy("tier", F.col("hits").desc(), "place"))


def quality_score(weights: dict[str, float] | None = None) -> Column:
    """0..1 score of a candidate from its seven dimensions."""
    weights = weights or fixed.SOURCE_WEIGHTS
    machine = F.when(F.col("machine_readable"), F.lit(1.0)).otherwise(F.lit(0.35))
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + (machine if name == "machine_readable" else F.col(name)) * F.lit(weight)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.lit(sum(weights.values()))))


def score_candidates(candidates: DataFrame, tie: str = "ord") -> DataFrame:
    return candidates.withColumn("quality_score", quality_score()).orderBy(F.col("quality_score").desc(), tie)


def distinct_urls(results: DataFrame, url: str = "url") -> DataFrame:
    """First result for each page, whatever its address spelling. One aggregation: no window over a hot address."""
    rest = [c for c in results.columns]
    first = results.groupBy(normalise_url(url).alias("url_key")).agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return first.select("url_key", *[F.col("r")[c].alias(c) for c in rest])


def unseen_urls(results: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Results whose page is not in ``seen(url)``."""
    known = seen.select(normalise_url("url").alias("url_key")).distinct()
    return results.withColumn("url_key", normalise_url(url)).join(known, "url_key", "left_anti").drop("url_key")


def cap_per_host(results: DataFrame, limit: int = 3, url: str = "url") -> DataFrame:
    """At most ``limit`` distinct pages per host, in arrival order."""
    host = F.coalesce(F.nullif(host_of(url), F.lit("")), F.lit("web"))
    pages = distinct_urls(results, url).withColumn("host", host)
    return first_per_group(pages, ["host"], [F.col("ord")], limit, "host_place")


def web_candidates(results: DataFrame, url: str = "url") -> DataFrame:
    """Results with host, authority of the host, and whether the address looks machine-readable."""
    machine = F.col(url).rlike(r"(?i)\.(csv|json|xlsx?|tsv)(\?|$)") | F.col(url).rlike("(?i)/api/")
    return results.withColumns({"host": host_of(url), "machine_readable": machine}).withColumn("authority", host_authority("host"))


def top_per_source(hits: DataFrame, per_source: int = 5) -> DataFrame:
    """The first hits of each source, tiers in order. ``hits(source, tier, ord)``."""
    return first_per_group(hits, ["source"], [F.col("ord")], per_source, "place").orderBy("tier", "source", "place")


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with accept/reject decisions; the one picked first is primary. ``decisions(candidate_id, accept, pick)``."""
    joined = candidates.join(decisions, "candidate_id", "left")
    return joined.withColumn("primary", F.coalesce(F.col("accept") & (F.col("pick") == 1), F.lit(False)))


def query_words(metric: str) -> list[tuple[str, str]]:
    """Words of a metric that count for matching, each with its singular."""
    out = []
    for word in re.split(r"[^a-z0-9]+", metric.lower()):
        if len(word) <= 2 or word in fixed.NAME_MATCH_STOP_WORDS:
            continue
        single = word
        if word.endswith("ies") and len(word) > 4:
            single = word[:-3] + "y"
        elif word.endswith("ses") and len(word) > 4:
            single = word[:-2]
        elif word.endswith("s") and not word.endswith("ss") and len(word) > 3:
            single = word[:-1]
        out.append((word, single))
    return out


def match_names(catalogue: DataFrame, metric: str, name: str = "name", least: float = 0.5) -> DataFrame:
    """Catalogue names sharing whole words with ``metric``, best first: words shared, then the shorter name.

    The metric's few words are literals in the plan, so this is one scan of the catalogue without a join.
    """
    words = query_words(metric)
    if not words:
        return catalogue.limit(0).withColumns({"matched": F.lit(0), "score": F.lit(0.0)})
    have = F.split(F.lower(F.col(name)), "[^a-z0-9]+")
    hits = sum((F.when(F.array_contains(have, w) | F.array_contains(have, s), 1).otherwise(0) for w, s in words), F.lit(0))
    scored = catalogue.withColumn("matched", hits).withColumn("score", F.col("matched") / F.lit(float(len(words))))
    return scored.filter((F.col("matched") > 0) & (F.col("score") >= least))


def match_order(name: str = "name", tie: str = "ord") -> list[Column]:
    return [F.col("matched").desc(), F.length(name), F.col(tie)]


# --- claims and pages ------------------------------------------------------------------------------------------

def match_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, f"[{BLANK}]+", " "))


def quotes_in_pages(quotes: DataFrame, pages: DataFrame, at_once: int = 4096) -> DataFrame:
    """Distinct (page_id, quote) of ``quotes`` whose page holds the quote's text; ``pages``: page_id, text. Both as ``match_text`` has them.

    A page's quotes are packed into rows of about ``at_once``, by hash, and its text meets these rows: it travels once, or once per
    so many quotes where a page has very many, never per quote. It is searched where it arrives and goes no further.
    """
    wanted = quotes.select("page_id", "quote").dropna().distinct()
    rows = wanted.groupBy("page_id").agg(F.ceil(F.count("*") / at_once).alias("_rows"))
    row = F.pmod(F.xxhash64("quote"), F.col("_rows")).alias("_row")
    packed = wanted.join(rows, "page_id").groupBy("page_id", row).agg(F.collect_list("quote").alias("_quotes"))
    held = F.filter("_quotes", lambda q: F.contains(F.col("text"), q))
    return packed.join(pages.select("page_id", "text"), "page_id").select("page_id", F.explode(held).alias("quote")).distinct()


def ground_claims(claims: DataFrame, pages: DataFrame, quotes_at_once: int = 4096) -> DataFrame:
    """Claims with a verdict: kept, or why dropped.

    A claim (page_id, entity, date, value, quote, ord) stands when its quote has 8 or more characters, occurs in
    its page's text and contains the value's digits. The first claim of an (entity, date) cell in a page stands.
    A page's distinct quotes are looked up together (``quotes_in_pages``); claims learn of it by an equi-join on page and
    quote. Duplicates are found by aggregation, not by a window.
    """
    quote = match_text(F.coalesce("quote", F.lit("")))
    asked = claims.withColumn("_quote", quote)
    found = quotes_in_pages(asked.filter(F.length("_quote") >= 8).select("page_id", F.col("_quote").alias("quote")),
                            pages.select("page_id", match_text("text").alias("text")), quotes_at_once)
    joined = asked.join(found.select("page_id", F.col("quote").alias("_quote"), F.lit(True).alias("_found")), ["page_id", "_quote"], "left")
    quote = F.col("_quote")
    number = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    digits = F.regexp_replace(number, "[^0-9.]", "")
    verdict = (F.when(F.length(quote) < 8, F.lit("short quote"))
               .when(F.col("_found").isNull(), F.lit("quote not in page"))
               .when(F.col("value").isNotNull() & ~quote.contains(number) & ~quote.contains(digits), F.lit("number not in quote")))
    # Written, as two branches read it.
    judged = write_stage(joined.withColumn("dropped", verdict).select(*claims.columns, "dropped"), "judged-claims")
    cell = ["page_id", F.lower(clean("entity")).alias("_e"), clean("date").alias("_d")]
    first = judged.filter("dropped is null").groupBy(*cell).agg(F.min("ord").alias("_first"))
    marked = judged.withColumns({"_e": F.lower(clean("entity")), "_d": clean("date")}).join(first, ["page_id", "_e", "_d"], "left")
    again = F.col("dropped").isNull() & (F.col("ord") != F.col("_first"))
    return marked.withColumn("dropped", F.when(again, F.lit("repeated cell")).otherwise(F.col("dropped"))).drop("_e", "_d", "_first")


def grounded_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposed links (run_id, url) that occur in a page read in the same run (run_id, url, text) or are a page's address.

    All pages of a run are read. The addresses of a text are taken out once and cut to every length that a link of the run has (as
    many as the longest link has characters, at most), so that a link meets the beginning of an address by an equi-join: links and
    addresses are never compared two by two, however many of one host a run has.
    """
    wanted = links.filter(F.col("url").rlike("^https?:")).select("run_id", "url").distinct()
    tails = F.regexp_extract_all(match_text("text"), F.lit(r"(?=(https?:\S*))"), F.lit(1))
    said = pages.select("run_id", F.explode(F.array_distinct(tails)).alias("_said")).distinct()
    asked = wanted.withColumn("_url", match_text(F.col("url")))
    sizes = asked.groupBy("run_id").agg(F.collect_set(F.length("_url")).alias("_sizes"))
    cut = F.transform(F.filter("_sizes", lambda n: n <= F.length("_said")), lambda n: F.substr(F.col("_said"), F.lit(1), n))
    begun = said.join(sizes, "run_id").select("run_id", F.explode(cut).alias("_url")).distinct()
    in_text = asked.join(begun, ["run_id", "_url"], "left_semi").select("run_id", "url")
    own = wanted.join(pages.select("run_id", "url").distinct(), ["run_id", "url"], "left_semi")
    return in_text.unionByName(own).distinct()
