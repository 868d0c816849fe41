"""Direction tagging of candidates and the viewer goal model."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.arrays import or_empty, overlaps
from ..functions.text import collapse, truncate
from .aggregates import FEEDBACK_KINDS, INTERACTION_KINDS

NO_DIRECTION = "No clear public direction signals."
UNCLEAR_GOAL = "Goal direction is still under-specified."


def tags_of(text: Column, directions=V.DIRECTIONS) -> Column:
    """Direction tags whose pattern occurs in the text, in vocabulary order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(tag))
                                     for tag, _, patterns in directions]))


def label_summary(tags: Column, directions=V.DIRECTIONS, limit: int = 3) -> Column:
    labels = F.create_map(*[F.lit(x) for tag, label, _ in directions for x in (tag, label)])
    named = F.transform(F.slice(tags, 1, limit), lambda t: F.coalesce(F.try_element_at(labels, t), t))
    return F.when(F.size(tags) == 0, NO_DIRECTION).otherwise(F.array_join(named, " / "))


def direction_texts(persons: DataFrame, evidence: DataFrame) -> DataFrame:
    """(person_id, source, text) of everything that may show a direction."""
    own = persons.select("person_id", F.explode(F.array(
        F.struct(F.lit("headline").alias("source"), F.col("headline").alias("text")),
        F.struct(F.lit("summary").alias("source"), F.col("summary").alias("text")))).alias("x")).select("person_id", "x.*")
    kind = F.col("evidence_type")
    field_ok = (kind != "profile_field") | F.coalesce(F.col("field").isin(V.DIRECTION_FIELDS), F.lit(False))
    rows = evidence.filter(kind.isin(V.DIRECTION_EVIDENCE) & field_ok)
    name = F.when(kind == "summary", "summary_evidence").otherwise(kind)
    titles = rows.filter(kind != "profile_field").select("person_id", name.alias("source"), F.col("title").alias("text"))
    bodies = rows.select("person_id", name.alias("source"), F.col("description").alias("text"))
    return own.unionByName(titles).unionByName(bodies).filter(collapse("text") != "")


def direction_signals(texts: DataFrame, directions=V.DIRECTIONS) -> DataFrame:
    """Distinct (person, tag, source, text) signals. Equal texts are reduced to one before tagging."""
    unique = texts.select("person_id", "source", collapse("text").alias("text")).distinct()
    return unique.select("person_id", "source", F.explode(tags_of(F.col("text"), directions)).alias("tag"),
                         truncate("text", 140, 139, "…").alias("matched_text")).distinct()


def direction_profiles(persons: DataFrame, texts: DataFrame, signals: DataFrame, directions=V.DIRECTIONS) -> DataFrame:
    """Tags, label summary, confidence and text count per person."""
    order = F.create_map(*[F.lit(x) for i, (tag, _, _) in enumerate(directions) for x in (tag, i)])
    per = signals.groupBy("person_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct(F.try_element_at(order, F.col("tag")).alias("o"), "tag"))),
                    lambda x: x["tag"]).alias("tags"), F.countDistinct("source").alias("n_sources"))
    counts = texts.groupBy("person_id").agg(F.count(F.lit(1)).alias("public_evidence"))
    out = persons.select("person_id").join(per, "person_id", "left").join(counts, "person_id", "left")
    tags = or_empty("tags")
    confidence = (F.when((F.size(tags) >= 2) & (F.col("n_sources") >= 2), "high").when(F.size(tags) >= 1, "medium")
                  .otherwise("low"))
    return out.select("person_id", tags.alias("tags"), label_summary(tags, directions).alias("summary"),
                      confidence.alias("confidence"), F.coalesce("public_evidence", F.lit(0)).alias("public_evidence"))


# --- viewer goal model ------------------------------------------------------------------------
def event_signals(events: DataFrame) -> DataFrame:
    """Viewer events -> (viewer_id, signal_group, tag)."""
    group = F.when(F.col("kind").isin(FEEDBACK_KINDS), "feedback").when(F.col("kind").isin(INTERACTION_KINDS), "interaction")
    rows = events.select("viewer_id", group.alias("signal_group"), F.explode("tags").alias("tag"))
    return rows.filter(F.col("signal_group").isNotNull())


def text_signals(texts: DataFrame, directions=V.DIRECTIONS) -> DataFrame:
    """(viewer_id, signal_group, text) -> (viewer_id, signal_group, tag)."""
    return texts.select("viewer_id", "signal_group", F.explode(tags_of(collapse("text"), directions)).alias("tag"))


def direction_counts(signals: DataFrame) -> DataFrame:
    """How many signal groups of a viewer hold each tag (a tag counts once per group)."""
    return signals.filter(F.col("signal_group") != "excluded").select("viewer_id", "signal_group", "tag").distinct().groupBy(
        "viewer_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def goal_models(events: DataFrame, texts: DataFrame, directions=V.DIRECTIONS) -> DataFrame:
    """One goal model per viewer.

    texts: (viewer_id, signal_group in explicit_goal / current_conditions / search_history / excluded, text).
    Tags are distinct per (viewer, group) before anything is gathered, so the arrays are bounded by the
    number of directions.
    """
    order = F.create_map(*[F.lit(x) for i, (tag, _, _) in enumerate(directions) for x in (tag, i)])
    signals = event_signals(events).unionByName(text_signals(texts, directions)).distinct()
    counts = direction_counts(signals).groupBy("viewer_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]).alias("dominant"))

    def tags(where, name):
        pairs = F.struct(F.try_element_at(order, F.col("tag")).alias("o"), "tag")
        return F.transform(F.array_sort(F.collect_set(F.when(where, pairs))), lambda x: x["tag"]).alias(name)

    group = F.col("signal_group")
    sets = signals.groupBy("viewer_id").agg(
        tags(group == "explicit_goal", "explicit"), tags(~group.isin("explicit_goal", "excluded"), "recent"),
        tags(group == "excluded", "negative"))
    used = texts.filter(collapse("text") != "").select("viewer_id", F.when(group == "excluded", "current_conditions")
                                                       .otherwise(group).alias("g")).distinct()
    kinds = events.select("viewer_id", F.when(F.col("kind").isin(FEEDBACK_KINDS), "feedback").when(
        F.col("kind").isin(INTERACTION_KINDS), "interaction").alias("g")).filter("g IS NOT NULL").distinct()
    names = ["explicit_goal", "current_conditions", "search_history", "feedback", "interaction"]
    groups = used.unionByName(kinds).groupBy("viewer_id").agg(F.collect_set("g").alias("_g"))
    viewers = groups.join(sets, "viewer_id", "left").join(counts, "viewer_id", "left")
    weights = events.groupBy("viewer_id").agg(*[F.count_if(F.col("kind") == k).alias(f"w_{k}") for k in FEEDBACK_KINDS])
    out = viewers.join(weights, "viewer_id", "left").select(
        "viewer_id", *[or_empty(c).alias(c) for c in ("dominant", "explicit", "recent", "negative")],
        F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("_g", n)).alias("signal_sources"),
        *[F.coalesce(f"w_{k}", F.lit(0)).alias(k) for k in FEEDBACK_KINDS])
    missing = (F.size("explicit") == 0) | (F.size("recent") == 0)
    out = out.withColumn("drift", F.when(missing, "unknown").when(overlaps("explicit", "recent"), "aligned").otherwise("shifting"))
    shifting = F.concat(F.lit("Explicit goal leans "), label_summary(F.col("explicit"), directions),
                        F.lit(", while recent behavior leans "), label_summary(F.col("recent"), directions), F.lit("."))
    centred = F.concat(F.lit("Current goal centers on "), label_summary(F.col("dominant"), directions), F.lit("."))
    return out.withColumn("summary", F.when(F.size("dominant") == 0, UNCLEAR_GOAL).when(
        F.col("drift") == "shifting", shifting).otherwise(centred))


