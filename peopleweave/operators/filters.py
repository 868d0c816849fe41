"""Filters and predicates over persons, documents, evidence, posts and claims."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.arrays import overlaps
from ..functions.text import (bind, context_term_match, index_term_match, is_strong_term, normalize_search_text, trim_ws)


def searchable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "active")


def displayable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") != "hidden")


def location_variants(locations) -> list[str]:
    both = {**V.LOCATION_FAMILIES, **{v[0]: v for v in V.LOCATION_FAMILIES.values()}}
    out: list[str] = []
    for loc in dict.fromkeys(x.strip().lower() for x in locations if x.strip()):
        out += [loc, *both.get(loc, [])]
    return list(dict.fromkeys(out))


def location_predicate(locations, facet: str = "facet_location", primary: str = "location") -> Column:
    """Facet overlap, or facet text contains, or primary location contains (any variant, any case)."""
    wanted = location_variants(locations)
    if not wanted:
        return F.lit(True)
    terms = F.array(*[F.lit(w) for w in wanted])
    primary_hit = F.exists(terms, lambda t: F.contains(F.lower(F.coalesce(F.col(primary), F.lit(""))), t))
    facet_hit = F.exists(F.coalesce(F.col(facet), F.array().cast("array<string>")),
                         lambda v: F.exists(terms, lambda t: F.contains(F.lower(v), t)))
    return overlaps(facet, terms) | facet_hit | primary_hit


def source_predicate(sources, bias: str | None = None, facet: str = "facet_source") -> Column:
    wanted = list(dict.fromkeys(s.strip().lower() for s in [*sources, *([bias] if bias else [])] if s.strip()))
    return overlaps(facet, F.array(*[F.lit(s) for s in wanted])) if wanted else F.lit(True)


def usable_must_haves(terms: Column, limit: int = 20) -> Column:
    """Trim, drop blanks and weak words, cap the list, keep only terms strong enough to test."""
    weak = reduce(lambda a, b: a + "|" + b, V.WEAK_MUST_HAVE)
    kept = F.filter(F.transform(terms, trim_ws), lambda t: (t != "") & ~t.rlike("(?i)" + weak))
    return F.filter(F.transform(F.slice(kept, 1, limit), lambda t: normalize_search_text(t)), is_strong_term)


def must_have_predicate(terms, normalized_text: str) -> Column:
    """ALL terms have to match the normalised text."""
    array = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    usable = usable_must_haves(array)
    return bind(F.col(normalized_text), lambda text: F.forall(usable, lambda t: index_term_match(t, text)))


def any_term_predicate(terms, normalized_text: str, limit: int = 12) -> Column:
    array = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    usable = F.filter(F.transform(F.array_distinct(F.transform(array, lambda t: F.lower(trim_ws(t)))),
                                  lambda t: normalize_search_text(t)), is_strong_term)
    kept = F.slice(usable, 1, limit)
    return bind(F.col(normalized_text), lambda text: F.exists(kept, lambda t: index_term_match(t, text)))


def failed_filters(context: Column, must: Column, exclude: Column, source_bias: Column, facet_source: Column) -> Column:
    """Names of the state filters a row fails. Sources are compared in normalised form."""
    low = F.lower(context)
    missing = ~bind(low, lambda text: F.forall(must, lambda t: context_term_match(t, text)))
    excluded = bind(low, lambda text: F.exists(exclude, lambda t: context_term_match(t, text)))
    wrong = source_bias.isNotNull() & ~F.array_contains(F.transform(facet_source, F.lower), source_bias)
    return F.array_compact(F.array(F.when(missing, F.lit("must_have")), F.when(excluded, F.lit("exclude")),
                                   F.when(wrong, F.lit("source_bias"))))


def enrichment_targets(evidence: DataFrame, profiles: DataFrame) -> DataFrame:
    """External http links of social and project evidence not already known as web profiles."""
    hosts = reduce(lambda a, b: a | b, [F.col("url").contains(h) for h in V.ENRICH_EXCLUDED_HOSTS])
    known = profiles.filter(F.col("source") == V.WEB_SOURCE).select("url").distinct()
    return evidence.filter(F.col("evidence_type").isin("social", "project") & F.col("url").startswith("http")
                           & ~hosts).join(known, "url", "left_anti")


def is_noise_segment(segment: Column, titles: str = V.STRONG_TITLE, phrases: str = V.ROLE_NOISE) -> Column:
    """Hiring or seeking phrases, partner adverts, and long segments without a job title."""
    lower = F.lower(segment)
    long_untitled = (F.length(segment) > 36) & ~lower.rlike(titles)
    return lower.rlike(phrases) | segment.contains(V.ROLE_NOISE_SEGMENT) | long_untitled


def scan_posts(refs: DataFrame, keywords: list[str]) -> DataFrame:
    """Handles of post references whose name, description or post text matches any keyword."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "description", "content")])
    hit = refs.filter((F.coalesce(F.col("handle"), F.lit("")) != "") & text.rlike("(?i)" + "|".join(keywords)))
    return hit.groupBy("handle").agg(F.count(F.lit(1)).alias("matches"))


def list_claims(claims: DataFrame, status=None, method=None, limit: int = 50, offset: int = 0) -> DataFrame:
    if status in ("pending", "approved", "rejected", "revoked"):
        claims = claims.filter(F.col("status") == status)
    if method in ("email", "github"):
        claims = claims.filter(F.col("method") == method)
    return claims.orderBy(F.desc("submitted_at"), "claim_id").offset(max(0, offset)).limit(min(200, limit))
