"""Search-document build: text, facets, rank features, incremental refresh."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.arrays import or_empty
from ..functions.text import document_alias_terms, role_segments, trim_ws, word_hits
from . import goals
from .aggregates import rank_features
from .common import distinct_values
from .filters import is_noise_segment


def role_labels(segment: Column) -> Column:
    """Role labels of one segment; specific titles win over general ones."""
    low = F.lower(segment)

    def has(pattern):
        return low.rlike(pattern)

    short = F.length(segment) <= 36
    product, ai = has(V.PRODUCT_SIGNAL), has(V.AI_DOMAIN)
    engineer, developer = has(V.ENGINEER_SIGNAL), has(V.DEVELOPER_SIGNAL)
    founder = F.when(has("(co[- ]?founder|联合创始人)"), "联合创始人").when(has("(founder|创始人)"), "创始人")
    simple = [F.when(has(p) | ((~product & short & has(V.GROWTH_SIGNAL)) if label == "运营" else F.lit(False)), label)
              for label, p in V.SIMPLE_ROLES]
    stack = (F.when(has("full[- ]?stack|全栈"), "全栈工程师").when(has("backend|后端"), "后端工程师")
             .when(has("frontend|前端"), "前端工程师"))
    research = F.when(ai & has(V.RESEARCH_SIGNAL), "AI研究员").when(has(V.EXPLICIT_RESEARCHER), "研究员")
    general = F.when(stack.isNull(), F.when(ai & (engineer | (short & developer)), "AI工程师")
                     .when(has(V.INDEPENDENT_SIGNAL), "独立开发者").when(engineer, "工程师").when(developer, "开发者"))
    labels = F.array_compact(F.array(founder, *simple, stack, research, general))
    return F.when((segment == "") | is_noise_segment(segment), F.array().cast("array<string>")).otherwise(labels)


def role_texts(persons: DataFrame, evidence: DataFrame) -> DataFrame:
    """Texts that may name a role. ``evidence`` may have ``role_signals``, the array that its metadata holds."""
    kind = F.col("evidence_type")
    own = persons.select("person_id", F.explode(F.array("headline", "summary")).alias("text"))
    fields = evidence.filter((kind == "profile_field") & F.col("field").isin(V.ROLE_FIELDS)).select(
        "person_id", F.col("description").alias("text"))
    work = evidence.filter(kind.isin("job_signal", "experience")).select(
        "person_id", F.explode(F.array("title", "description")).alias("text"))
    if "role_signals" in evidence.columns:
        fields = fields.unionByName(evidence.select("person_id", F.explode("role_signals").alias("text")))
    return own.unionByName(fields).unionByName(work).filter(F.col("text").isNotNull()).distinct()


def role_facets(persons: DataFrame, evidence: DataFrame) -> DataFrame:
    segments = role_texts(persons, evidence).select("person_id", F.explode(role_segments("text")).alias("segment")).distinct()
    return distinct_values(segments.select("person_id", F.explode(role_labels(F.col("segment"))).alias("label")),
                           ["person_id"], "label", "facet_role")


def place_names(location: Column) -> Column:
    """Full path, its '/' parts and the parts without administrative suffix, all lower."""
    parts = F.filter(F.transform(F.split(location, "/"), trim_ws), lambda p: p != "")
    short = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, V.PLACE_SUFFIX, "")), lambda p: p != "")
    return F.array_distinct(F.transform(F.concat(F.array(location), parts, short), F.lower))


def location_facets(persons: DataFrame, evidence_places: DataFrame) -> DataFrame:
    """evidence_places: (person_id, place) from evidence metadata."""
    own = persons.filter(F.coalesce("location", F.lit("")) != "").select(
        "person_id", F.explode(place_names(F.col("location"))).alias("place"))
    other = evidence_places.filter(F.coalesce("place", F.lit("")) != "").select("person_id", F.lower("place").alias("place"))
    return distinct_values(own.unionByName(other), ["person_id"], "place", "facet_location")


def source_facets(evidence: DataFrame, hints: DataFrame) -> DataFrame:
    rows = hints.select("person_id", F.lower("source").alias("source")).unionByName(evidence.select("person_id", "source"))
    return distinct_values(rows, ["person_id"], "source", "facet_source")


def seeded_persons(hints: DataFrame, seeds: DataFrame, source: str = V.PROFILE_SOURCE) -> DataFrame:
    """Persons having a handle of the caller's curated list (handles compared lower-case)."""
    listed = seeds.select(F.lower("handle").alias("_h")).distinct()
    own = hints.filter(F.lower("source") == source).withColumn("_h", F.lower("handle"))
    return own.join(listed, "_h", "left_semi").select("person_id").distinct()


def tag_facets(persons, evidence, hints, seeds, directions=V.DIRECTIONS, keywords=V.TECH_KEYWORDS) -> DataFrame:
    """Keywords found in text, repository languages, the curated-list tag and direction tags.

    Each distinct text is scanned once; a keyword spanning two evidence items is not a hit.
    """
    texts = persons.select("person_id", F.explode(F.array("headline", "summary")).alias("text")).unionByName(
        evidence.select("person_id", F.concat_ws(" ", "title", "description").alias("text")))
    texts = texts.filter("text IS NOT NULL").select("person_id", F.lower("text").alias("text")).distinct()
    found = texts.select("person_id", F.explode(word_hits(F.col("text"), keywords)).alias("tag"))
    languages = evidence.filter((F.col("evidence_type") == "repository") & F.col("language").isNotNull()).select(
        "person_id", F.lower("language").alias("tag"))
    seeded = seeded_persons(hints, seeds).withColumn("tag", F.lit(V.SEED_TAG))
    signals = goals.direction_signals(goals.direction_texts(persons, evidence), directions)
    tagged = signals.select("person_id", F.concat(F.lit(V.DIRECTION_PREFIX), "tag").alias("tag"))
    return distinct_values(found.unionByName(languages).unionByName(seeded).unionByName(tagged), ["person_id"], "tag",
                           "facet_tags")


def document_texts(persons: DataFrame, evidence: DataFrame) -> DataFrame:
    """(person_id, doc_text): one row per person, the evidence texts in the order of their ids.

    Persons are spread over the tasks by their id; a task holds the text of one person at a time, which is the row itself.
    """
    texts = evidence.select("person_id", "evidence_id", F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("description", F.lit(""))).alias("text")).filter("text <> ''")
    texts = texts.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))), lambda x: x["text"]), " ").alias("body"))
    own = persons.select("person_id", F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "headline", "summary", "location")]).alias("own"))
    joined = own.join(texts, "person_id", "left").withColumn("body_text", F.concat_ws(" ", F.nullif("own", F.lit("")), F.nullif("body", F.lit(""))))
    terms = document_alias_terms("body_text")
    return joined.select("person_id", F.concat_ws(" ", F.nullif("body_text", F.lit("")), F.nullif(F.array_join(terms, " "), F.lit(""))).alias("doc_text"))


def build_documents(persons, evidence, hints, seeds, evidence_places, now, directions=V.DIRECTIONS) -> DataFrame:
    """The full search document, one row per person: text, facets and rank features."""
    facets = [role_facets(persons, evidence), location_facets(persons, evidence_places), source_facets(evidence, hints),
              tag_facets(persons, evidence, hints, seeds, directions)]
    out = document_texts(persons, evidence)
    for facet in facets:
        out = out.join(facet, "person_id", "left")
    out = out.join(rank_features(persons, evidence, now), "person_id", "left")
    return out.select(
        "person_id", "doc_text", *[or_empty(c).alias(c) for c in (
            "facet_role", "facet_location", "facet_source", "facet_tags")],
        F.struct("evidence_count", "project_count", "repo_count", "follower_count", "freshness").alias("rank_features"),
        F.lit(now).cast("timestamp").alias("updated_at"))


def rebuild_targets(persons: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """None rebuilds every active person; a table rebuilds its persons; an empty table does nothing."""
    if targets is None:
        return persons.filter("status = 'active'")
    return persons.join(targets.select("person_id").distinct(), "person_id", "left_semi")
