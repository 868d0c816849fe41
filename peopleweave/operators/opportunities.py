"""Opportunity scoring and the curated daily list of each viewer."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, OpportunityConfig
from ..functions.arrays import or_empty
from ..functions.similarity import clamp01
from .common import top_k
from .goals import label_summary

# Reason sentences of the daily list.
WHY_NOW = ["You deferred this earlier and enough time has passed to revisit it with a fresh push.",
           "Signals are fresh and the path to outreach is comparatively direct, so it is worth acting now.",
           "Your recent viewing behavior suggests this direction is worth turning into an actual outreach attempt.",
           "This is one of the strongest direction matches in today's pool, so it belongs near the top of the queue.",
           "This is still worth a lightweight validation touch because it survives the direction-first ranking without a strong contradiction."]
WHY_UNCERTAIN = ["Some public signals overlap with directions you have explicitly pushed away from.",
                 "Public-expression evidence is too sparse to infer a clear direction.",
                 "The candidate's public direction signals do not line up clearly with your current goal model yet.",
                 "The direction match is plausible, but supported by only a small number of public signals."]
APPROACH = ["Start with a direct peer-style intro from their Bonjour profile and anchor on the shared direction.",
            "Lead with their open-source work and ask what they want to build next in this space.",
            "Reference the project they are already building and ask how they think the space evolves from here.",
            "Open with a concrete builder-to-builder question about developer tooling pain points.",
            "Use their public profile direction directly and ask what kind of company or product they actually want to build."]
DRIFT_NOTE = ("Recent feedback and behavior are starting to lean away from the original stated direction. "
              "Keep the list exploratory until that settles.")


def candidate_facts(pool: DataFrame, evidence: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pool rows with direction profile and evidence flags. pool: (person_id, facet_source, freshness, ...)."""
    flags = evidence.join(pool.select("person_id"), "person_id", "left_semi").groupBy("person_id").agg(
        F.max(F.col("evidence_type") == "repository").alias("has_repo"), F.max(F.col("evidence_type") == "project").alias("has_project"))
    j = pool.join(profiles.select("person_id", "tags", F.col("summary").alias("direction_summary"),
                                  F.col("confidence").alias("profile_confidence")), "person_id", "left").join(flags, "person_id", "left")
    return j.withColumns({"tags": or_empty("tags"), "profile_confidence": F.coalesce("profile_confidence", F.lit("low")),
                          "has_repo": F.coalesce("has_repo", F.lit(False)), "has_project": F.coalesce("has_project", F.lit(False))})


def direction_match() -> tuple[Column, Column, Column]:
    """(score, overlap tags, negative overlap count) from viewer and candidate tag arrays."""
    dominant = F.slice("dominant", 1, 3)
    overlap = F.array_distinct(F.filter("tags", lambda t: F.array_contains("explicit", t) | F.array_contains(dominant, t) | F.array_contains("recent", t)))
    negative = F.size(F.filter("tags", lambda t: F.array_contains("negative", t)))
    per_tag = F.aggregate("overlap_tags", F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(dominant, t), 0.34).otherwise(0.0)
                          + F.when(F.array_contains("explicit", t), 0.22).otherwise(0.0) + F.when(F.array_contains("recent", t), 0.12).otherwise(0.0))
    weak = F.when((F.size("overlap_tags") == 0) & (F.size("tags") > 0), 0.05).otherwise(0.0)
    sure = F.when(F.col("profile_confidence") == "high", 0.08).when(F.col("profile_confidence") == "medium", 0.03).otherwise(0.0)
    return clamp01(per_tag + weak + sure - F.col("negative_overlap") * F.lit(0.25)), overlap, negative


VIEWER_PARTS = 64


def score_opportunities(viewers: DataFrame, candidates: DataFrame, state: DataFrame, cfg: OpportunityConfig = DEFAULT.opportunity,
                        directions=V.DIRECTIONS) -> DataFrame:
    """Every viewer against every candidate of the daily pool, which ``candidate_pool`` has cut to ``cfg.pool_keep`` persons.

    Viewers are dealt into ``VIEWER_PARTS`` parts by hash and each part meets a copy of the pool in an equi-join, so nothing passes the driver
    and candidates beyond the usual number are scored as well.
    """
    dealt = viewers.withColumn("_part", F.pmod(F.xxhash64("viewer_id"), F.lit(VIEWER_PARTS)).cast("int"))
    copies = candidates.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(VIEWER_PARTS - 1))))
    j = dealt.join(copies, "_part").drop("_part")
    j = j.join(state, ["viewer_id", "person_id"], "left")
    score, overlap, negative = direction_match()
    j = j.withColumns({"overlap_tags": overlap, "negative_overlap": negative}).withColumn("direction", score)
    sources = or_empty("facet_source")
    has_profile, has_code = F.array_contains(sources, V.PROFILE_SOURCE), F.array_contains(sources, V.CODE_SOURCE)
    reach = (F.when(has_profile, 1.0).when(has_code & F.col("has_repo"), 0.72).when(F.col("has_project"), 0.62)
             .when(F.size(sources) > 0, 0.5).otherwise(0.35))
    known = F.col("seen_count").isNotNull()
    last, detail, repeat = F.col("last_feedback"), F.coalesce("detail_count", F.lit(0)), F.coalesce("repeat_count", F.lit(0))
    views = clamp01(F.lit(0.35) + F.least(detail, F.lit(3)) * F.lit(0.18) + F.least(repeat, F.lit(3)) * F.lit(0.22))
    engagement = (F.when(~known, 0.5).when(last == "not_interested", 0.0).when(last == "interested", 1.0).otherwise(views))
    days = F.coalesce("days_since_surfaced", F.lit(0))
    revisit = F.when(last == "revisit", F.when(days >= 7, 1.0).when(days >= 3, 0.7).otherwise(0.3)).otherwise(0.0)
    fresh = F.when(F.col("freshness").isNull(), 0.5).otherwise(clamp01(F.exp(-F.greatest(F.col("freshness"), F.lit(0)) / F.lit(180.0))))
    j = j.withColumns({"reachability": reach, "engagement": engagement, "revisit": revisit, "fresh": fresh,
                       "penalty": clamp01(F.col("negative_overlap") * F.lit(0.18))})
    secondary = (F.col("fresh") * cfg.freshness + F.col("reachability") * cfg.reachability + F.col("engagement") * cfg.engagement
                 + F.col("revisit") * cfg.revisit)
    capped = F.when(F.col("direction") < 0.2, F.least(secondary, F.lit(cfg.low_direction_cap))).otherwise(secondary)
    j = j.withColumn("total", clamp01(F.col("direction") * cfg.direction + capped - F.col("penalty")))
    return _explain(j, directions)


def _explain(j: DataFrame, directions) -> DataFrame:
    tags, overlap = F.col("tags"), F.col("overlap_tags")
    sources, last = or_empty("facet_source"), F.col("last_feedback")
    unsure = (F.when(F.col("negative_overlap") > 0, WHY_UNCERTAIN[0]).when(F.size(tags) == 0, WHY_UNCERTAIN[1])
              .when(F.size(overlap) == 0, WHY_UNCERTAIN[2]).when(F.col("profile_confidence") == "medium", WHY_UNCERTAIN[3]))
    explicit = F.array_contains("signal_sources", "explicit_goal")
    matched = (F.when(F.size(overlap) > 0, F.concat(F.lit("Shared direction around "), label_summary(overlap, directions), F.lit(".")))
               .when(F.size(tags) > 0, F.concat(F.lit("Public profile leans "), label_summary(tags, directions),
                                                F.lit(", but overlap with your current direction is still weak.")))
               .when(explicit, "Direction evidence is thin; surfaced as a weak-fit candidate for validation only.")
               .otherwise("Direction evidence is still thin on both sides, so this is a low-confidence validation candidate."))
    now = (F.when((last == "revisit") & (F.col("revisit") >= 0.7), WHY_NOW[0]).when((F.col("fresh") >= 0.75) & (F.col("reachability") >= 0.7), WHY_NOW[1])
           .when((F.coalesce("repeat_count", F.lit(0)) > 0) | (F.coalesce("detail_count", F.lit(0)) > 1), WHY_NOW[2])
           .when(F.col("total") >= 0.65, WHY_NOW[3]).otherwise(WHY_NOW[4]))
    path = (F.when(F.array_contains(sources, V.PROFILE_SOURCE), APPROACH[0]).when(F.array_contains(tags, "open_source") | F.col("has_repo"), APPROACH[1])
            .when(F.col("has_project"), APPROACH[2]).when(F.array_contains(tags, "developer_tools"), APPROACH[3]).otherwise(APPROACH[4]))
    j = j.withColumns({"why_uncertain": unsure, "why_matched": matched, "why_now": now, "approach": path})
    confidence = (F.when((F.col("direction") >= 0.55) & (F.col("profile_confidence") == "high") & F.col("why_uncertain").isNull(), "high")
                  .when((F.col("direction") >= 0.24) & (F.col("profile_confidence") != "low"), "medium").otherwise("low"))
    j = j.withColumn("confidence", confidence)
    bucket = (F.when(last == "revisit", "revisit").when((F.col("confidence") == "high") & (F.col("direction") >= 0.45) & (F.col("total") >= 0.58), "high-confidence")
              .when(F.coalesce("seen_count", F.lit(0)) == 0, "new").otherwise("needs-validation"))
    return j.withColumn("bucket", F.coalesce(bucket, F.lit("new")))


def curate(scored: DataFrame, cfg: OpportunityConfig = DEFAULT.opportunity) -> DataFrame:
    """Per viewer the best ``size`` candidates that are not suppressed; the first ``top_count`` are 'top', the rest 'more'."""
    last, total = F.coalesce("last_feedback", F.lit("")), F.col("total")
    gone = F.col("contacted_at").isNotNull() | (last == "contacted")
    disliked = (last == "not_interested") & (total < 0.75)
    again = (F.coalesce(F.col("days_since_surfaced") < cfg.suppression_days, F.lit(False))) & (last != "revisit") & (total < 0.78)
    listed = top_k(scored.filter(~gone & ~disliked & ~again), ["viewer_id"], [F.desc("total"), "person_id"], cfg.size)
    return listed.withColumn("section", F.when(F.col("rank") <= cfg.top_count, "top").otherwise("more"))


def surfaced_events(listed: DataFrame, now) -> DataFrame:
    """Events to append so the next day's state knows what was shown."""
    return listed.select(F.xxhash64("viewer_id", "person_id", F.lit(str(now))).alias("event_id"), "viewer_id", "person_id",
                         F.lit("surfaced").alias("kind"), F.array().cast("array<string>").alias("tags"), F.lit(now).cast("timestamp").alias("ts"))


def drift_notes(goals: DataFrame) -> DataFrame:
    return goals.select("viewer_id", "drift", F.when(F.col("drift") == "shifting", DRIFT_NOTE).alias("note"))
