"""Ranking, first-wins picks, top-N lists, sorts, paging and set operations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, OpportunityConfig
from ..functions.text import blank_to_null, normalize_search_text
from .common import best_row, positions, top_k


def weight_of(kind: Column, table: dict, missing: int) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, kind), F.lit(missing))


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    return best_row(df, keys, F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]), maximum=False)


def primary_fields(profiles: DataFrame) -> DataFrame:
    """Best name, headline, avatar and location of each person's profiles (seq = profile order).

    Source A wins where it has a value, then the first profile with one; the location is the one with
    most '/' levels, earliest on ties.
    """
    a_first = F.when(F.col("source") == V.PROFILE_SOURCE, 0).otherwise(1)

    def pick(name):
        value = blank_to_null(name)
        return F.min_by(value, F.when(value.isNotNull(), F.struct(a_first.alias("a"), F.col("seq").alias("s"))))

    place = blank_to_null("location")
    depth = F.size(F.split(place, "/"))
    return profiles.groupBy("person_id").agg(
        F.coalesce(pick("display_name"), F.min_by("handle", "seq"), F.lit("Unknown")).alias("name"),
        pick("headline").alias("headline"),
        F.min_by(place, F.when(place.isNotNull(), F.struct((-depth).alias("d"), F.col("seq").alias("s")))).alias("location"))


def component_winners(members: DataFrame) -> DataFrame:
    """(component, person_id, identities, evidence, created_at) -> the person kept."""
    order = F.struct((-F.col("identities")).alias("i"), (-F.col("evidence")).alias("e"), "created_at", "person_id")
    return members.groupBy("component").agg(F.min_by("person_id", order).alias("winner"),
                                            F.count(F.lit(1)).alias("members"))


def preview_evidence(evidence: DataFrame, n: int = 3) -> DataFrame:
    return top_k(evidence, ["person_id"], [F.desc("created_at"), "evidence_id"], n)


def strongest_evidence(evidence: DataFrame, n: int = 8) -> DataFrame:
    """By type weight, then newest."""
    weight = weight_of(F.col("evidence_type"), V.EVIDENCE_WEIGHTS, 4)
    return top_k(evidence.withColumn("weight", weight), ["person_id"],
                 [F.desc("weight"), F.desc_nulls_last("occurred_at"), "evidence_id"], n)


def comparison_evidence(evidence: DataFrame, n: int = 3) -> DataFrame:
    kept = evidence.filter(blank_to_null("title").isNotNull() | blank_to_null("description").isNotNull())
    priority = weight_of(F.col("evidence_type"), V.COMPARISON_PRIORITY, 99)
    return top_k(kept.withColumn("priority", priority), ["person_id"],
                 ["priority", F.desc_nulls_last("occurred_at"), "evidence_id"], n)


def work_links(evidence: DataFrame, n: int = 2) -> DataFrame:
    kept = evidence.filter(blank_to_null("url").isNotNull() & F.col("evidence_type").isin(list(V.LINK_PRIORITY)))
    priority = weight_of(F.col("evidence_type"), V.LINK_PRIORITY, 99)
    return top_k(kept.withColumn("priority", priority), ["person_id"],
                 ["priority", F.desc_nulls_last("occurred_at"), "evidence_id"], n)


def comparison_ranks(entries: DataFrame) -> DataFrame:
    """Rank inside a comparison set, its tag, and the winner's lead. A set holds at most a few rows."""
    w = Window.partitionBy("query_id").orderBy(F.desc("decision_score"), "person_id")
    tag = F.when(F.col("rank") == 1, "优先深看").when(F.col("rank") == 2, "继续比较").otherwise("补充候选")
    ahead = F.col("decision_score") - F.lead("decision_score").over(w)
    return entries.withColumn("rank", F.row_number().over(w)).withColumn("lead", ahead).withColumn("decision_tag", tag)


def first_expected(hits: DataFrame, golden: DataFrame) -> DataFrame:
    found = hits.join(golden.select("query_id", "person_id").distinct(), ["query_id", "person_id"], "left_semi")
    return found.groupBy("query_id").agg(F.min("rank").alias("position"))


def shortlist_index(hits: DataFrame) -> DataFrame:
    return positions(hits, ["query_id"], [F.desc("score"), "person_id"], "shortlist_index")


def same_name_groups(candidates: DataFrame) -> DataFrame:
    """Groups of at least two candidates of one query sharing a normalised name, with their sizes."""
    named = candidates.withColumn("name_norm", normalize_search_text("name")).filter("name_norm <> ''")
    sizes = named.groupBy("query_id", "name_norm").agg(F.count(F.lit(1)).alias("group_size"))
    return named.join(sizes.filter("group_size > 1"), ["query_id", "name_norm"])


def _ranked(scored: DataFrame, order, n: int | None) -> DataFrame:
    """The first ``n`` of each query, or whole lists, which range parts number so that no list is one task."""
    if n is not None:
        return top_k(scored, ["query_id"], order, n)
    return positions(scored, ["query_id"], order, "rank").withColumn("rank", F.col("rank").cast("int"))


def rerank_order(scored: DataFrame, mode: str, n: int | None = None) -> DataFrame:
    """fresh / source / evidence order: composite to three decimals, then the signals in mode order.

    The pairwise 0.001 tolerance of the interactive sort is not transitive; rounding to 0.001 gives
    the same order wherever that one is well defined. The product is rounded, as ``round`` itself would round the value's decimal text.
    """
    order = {"fresh": ["fresh", "evidence", "source", "match"], "source": ["source", "fresh", "evidence", "match"],
             "evidence": ["evidence", "fresh", "source", "match"]}[mode]
    return _ranked(scored, [F.desc(F.round(F.col("composite") * 1000, 0) / 1000), *[F.desc(c) for c in order], "person_id"], n)


def dimension_order(scored: DataFrame, dimension: str, n: int | None = None) -> DataFrame:
    return _ranked(scored, [F.desc(F.coalesce(F.col(dimension), F.lit(-1.0))), "person_id"], n)


def page(df: DataFrame, order, limit: int | float = 10, offset: int | float = 0, maximum: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(max(0, int(offset))).limit(max(1, min(maximum, int(limit))))


def seed_order(candidates: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    """Most occurrences, then named, then most kinds of sighting, then handle."""
    return candidates.orderBy(F.desc("occurrences"), F.desc(blank_to_null("name").isNotNull()),
                              F.desc(F.size("source_kinds")), "handle").offset(skip).limit(limit)


def candidate_pool(persons: DataFrame, docs: DataFrame, cfg: OpportunityConfig = DEFAULT.opportunity) -> DataFrame:
    """Newest documents of shown persons; those with a direction tag when there are any."""
    shown = persons.filter("status <> 'hidden'").join(docs, "person_id")
    newest = shown.orderBy(F.desc("doc_updated_at"), "person_id").limit(cfg.pool_scan)
    tagged = F.exists("facet_tags", lambda t: t.startswith(V.DIRECTION_PREFIX))
    # The pool is at most pool_scan rows, so one window over it is small by construction.
    flagged = newest.withColumn("_t", tagged).withColumn("_any", F.max("_t").over(Window.partitionBy(F.lit(0))))
    kept = flagged.filter(~F.col("_any") | F.col("_t")).drop("_t", "_any")
    return kept.orderBy(F.desc("doc_updated_at"), "person_id").limit(cfg.pool_keep)


def subtract_handles(handles: DataFrame, *known: DataFrame) -> DataFrame:
    for table in known:
        handles = handles.join(table.select("handle").distinct(), "handle", "left_anti")
    return handles


def collapse_aliases(records: DataFrame) -> DataFrame:
    """Records of the same source profile id become one, the first kept; without an id the handle counts."""
    pid = blank_to_null("source_profile_id")
    key = F.when(pid.isNotNull(), F.concat(F.lit("profile:"), pid)).otherwise(F.concat(F.lit("handle:"), F.col("handle")))
    return best_row(records.withColumn("collapse_key", key), ["collapse_key"], F.col("seq"), maximum=False)
