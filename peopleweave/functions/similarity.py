"""Similarity measures and match scores."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .text import col, contains_any, trim_ws


def trigrams(value) -> Column:
    """Distinct padded character trigrams of every word: two spaces before, one after.

    Words are padded and put on separate lines, then one regex pass takes every overlapping
    three-character window inside a line; no per-character lambda is evaluated. A window that begins inside
    a character beyond the basic plane comes out with a question mark, which no word holds, and is dropped.
    """
    text = F.regexp_replace(F.lower(col(value)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    padded = F.concat(F.lit("  "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " \n  "), F.lit(" "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.filter(F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=([^\n]{3}))"), F.lit(1))), lambda g: ~g.contains("?")))


def set_similarity(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def trigram_similarity(left, right) -> Column:
    return set_similarity(trigrams(left), trigrams(right))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def cosine(left, right) -> Column:
    """0 for missing, empty or unequal-length vectors and for zero norms."""
    a, b = col(left), col(right)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), _dot(a, b) / norm).otherwise(F.lit(0.0))


def clamp01(value: Column) -> Column:
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(value.isNull() | ~finite, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def name_key(value) -> Column:
    return F.regexp_replace(F.lower(trim_ws(value)), r"\s+", "")


def name_score(left, right) -> Column:
    a, b = F.lower(trim_ws(left)), F.lower(trim_ws(right))
    missing = F.coalesce(col(left) == "", F.lit(True)) | F.coalesce(col(right) == "", F.lit(True))
    return (F.when(missing, 0.0).when(a == b, 0.5).when(name_key(left) == name_key(right), 0.4)
            .when(F.contains(a, b) | F.contains(b, a), 0.25).otherwise(0.0))


def location_tokens(value) -> Column:
    return F.filter(F.split(F.lower(trim_ws(value)), r"\s*[,/]\s*|\s+"), lambda t: t != "")


def location_score(left, right) -> Column:
    a, b = location_tokens(left), location_tokens(right)
    missing = F.coalesce(col(left) == "", F.lit(True)) | F.coalesce(col(right) == "", F.lit(True))
    shared = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    return (F.when(missing, 0.0).when(F.lower(trim_ws(left)) == F.lower(trim_ws(right)), 0.3)
            .when(shared >= 2, 0.2).when(shared == 1, 0.1).otherwise(0.0))


def company_score(left_text: Column, left_aliases: Column, right_text: Column, right_aliases: Column) -> Column:
    """.2 when one side's organisation alias occurs in the other's text, .1 for a shared role keyword."""
    mention = F.exists(left_aliases, lambda x: F.contains(right_text, F.lower(x))) | F.exists(
        right_aliases, lambda x: F.contains(left_text, F.lower(x)))
    keyword = reduce(lambda x, y: x | y, [left_text.contains(k) & right_text.contains(k) for k in V.COMPANY_KEYWORDS])
    return F.when(F.coalesce(mention, F.lit(False)), 0.2).when(keyword, 0.1).otherwise(0.0)


def percent(value) -> Column:
    v = col(value)
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    scaled = F.when(v <= 1, v * 100).otherwise(v)
    return F.when(v.isNull() | ~finite, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)))


def _starts_any(text: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def match_strength(score, reasons) -> Column:
    """strong / medium / weak from the score and how many reasons are substantive or supportive."""
    v = col(score)
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    scaled = F.when(v.isNull() | ~finite, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v))))
    named = F.filter(F.transform(F.coalesce(col(reasons), F.array().cast("array<string>")), trim_ws), lambda r: r != "")
    solid = F.size(F.filter(named, lambda r: ~r.contains("fallback") & (
        _starts_any(r, V.SUBSTANTIVE_PREFIXES) | r.isin(V.SUBSTANTIVE_EXACT))))
    support = F.size(F.filter(named, lambda r: ~r.contains("fallback") & _starts_any(r, V.SUPPORTIVE_PREFIXES)))
    return (F.when(solid >= 2, "strong").when((solid >= 1) & (scaled >= 0.55), "strong").when(solid >= 1, "medium")
            .when((support >= 2) & (scaled >= 0.45), "medium").when((support >= 1) & (scaled >= 0.55), "medium")
            .when((scaled >= 0.7) & (F.size(named) > 0), "medium").otherwise("weak"))


def query_cache_key(skills, locations, experience, role, source_bias, must, nice, exclude, prefer_fresh) -> Column:
    """SHA-1 over sorted, lower-cased condition arrays."""
    def arr(c):
        items = F.coalesce(col(c), F.array().cast("array<string>"))
        return F.array_sort(F.filter(F.transform(items, lambda x: F.lower(trim_ws(x))), lambda x: x != ""))

    def text(c):
        return F.coalesce(F.lower(trim_ws(c)), F.lit(""))

    payload = F.to_json(F.struct(
        arr(skills).alias("skills"), arr(locations).alias("locations"), text(experience).alias("experience"),
        text(role).alias("role"), text(source_bias).alias("sourceBias"), arr(must).alias("mustHave"),
        arr(nice).alias("niceToHave"), arr(exclude).alias("exclude"),
        F.coalesce(col(prefer_fresh), F.lit(False)).alias("preferFresh")))
    return F.sha1(payload)
