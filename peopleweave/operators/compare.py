"""Comparison of shortlisted candidates and policies around it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import or_empty
from ..functions.dates import raw_age_days
from .common import top_k
from .windows import comparison_ranks


def decision_score(overall: Column, match: Column, age: Column, tech: Column, project: Column) -> Column:
    """.7 x profile + 20 x match + freshness 8/5/2 + 3 for tech >= 80 + 2 for project >= 70."""
    fresh = F.when(age <= 7, 8).when(age <= 30, 5).when(age <= 90, 2).otherwise(0)
    return (overall * 0.7 + match * 100 * 0.2 + F.when(age.isNotNull(), fresh).otherwise(0) + F.when(tech >= 80, 3).otherwise(0)
            + F.when(project >= 70, 2).otherwise(0))


def verdict(score: Column) -> Column:
    return F.when(score >= 75, "strong").when(score >= 55, "mixed").otherwise("weak")


def assess(candidates: DataFrame, now) -> DataFrame:
    """Decision score, four dimension scores with verdicts, and the uncertainty level.

    candidates: (query_id, person_id, overall, match_score, tech, project, sources, reasons, n_evidence,
    n_work_evidence, latest_evidence_at, last_synced_at)
    """
    age = raw_age_days(F.coalesce("latest_evidence_at", "last_synced_at"), now)
    c = candidates.withColumn("age", age)
    a = F.col("age")
    fresh = F.when(a.isNull(), 35).when(a <= 7, 90).when(a <= 30, 75).when(a <= 90, 60).otherwise(42)
    both = F.array_contains("sources", "Bonjour") & F.array_contains("sources", "GitHub")
    either = F.array_contains("sources", "Bonjour") | F.array_contains("sources", "GitHub")
    source = F.when(both, 88).when(either, 72).otherwise(48)
    c = c.withColumns({
        "decision_score": decision_score(F.col("overall"), F.col("match_score"), a, F.col("tech"), F.col("project")),
        "goal_fit": F.col("match_score") * 100 * 0.7 + F.col("overall") * 0.3,
        "evidence_strength": F.col("project") * 0.6 + F.col("n_evidence") * 10 + F.col("n_work_evidence") * 8,
        "technical": F.col("tech").cast("double"), "source_recency": fresh * 0.45 + source * 0.55})
    names = ["goal_fit", "evidence_strength", "technical", "source_recency"]
    c = c.withColumns({f"{n}_verdict": verdict(F.col(n)) for n in names})
    level = (F.when(F.col("evidence_strength_verdict") == "weak", "high")
             .when((F.col("source_recency_verdict") == "weak") | (F.size(or_empty("reasons")) == 0), "medium").otherwise("low"))
    shown = {n: F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col(n) + 0.5))).cast("int") for n in names}
    return c.withColumn("uncertainty", level).withColumns(shown)


def outcomes(assessed: DataFrame) -> DataFrame:
    """One recommendation per comparison set (sets hold at most a few candidates)."""
    ranked = comparison_ranks(assessed)
    sizes = assessed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    top = ranked.filter("rank = 1").join(sizes, "query_id")
    weak = (F.col("evidence_strength_verdict") == "weak") | (F.col("uncertainty") == "high") | (F.col("lead") < 6)
    conditional = (F.col("uncertainty") == "medium") | (F.col("lead") < 12) | (F.col("source_recency_verdict") == "mixed")
    mode = (F.when(F.col("n") < 2, "no-recommendation").when(weak, "no-recommendation")
            .when(conditional, "conditional-recommendation").otherwise("clear-recommendation"))
    confidence = F.when(F.col("mode") == "no-recommendation", "low-confidence").when(
        F.col("mode") == "conditional-recommendation", "medium-confidence").otherwise("high-confidence")
    return top.withColumn("mode", mode).select(
        "query_id", F.col("person_id").alias("lead_id"), "lead", "mode", confidence.alias("confidence"),
        F.when(F.col("mode") != "no-recommendation", F.col("person_id")).alias("recommended_id"))


def comparison_targets(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """Strong and medium candidates when there are two of them, else the head of the list.

    candidates: (query_id, person_id, rank, strength)
    """
    ready = F.coalesce(F.col("strength").isin("strong", "medium"), F.lit(False))
    counts = candidates.groupBy("query_id").agg(F.count_if(ready).alias("n_ready"))
    j = candidates.join(counts, "query_id")
    usable = j.filter((F.col("n_ready") < 2) | ready)
    return top_k(usable, ["query_id"], ["rank"], limit, "slot")


def post_search_actions(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """compare when at least two targets are strong or medium, else narrow."""
    ready = F.coalesce(F.col("strength").isin("strong", "medium"), F.lit(False))
    counts = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ready).alias("n_ready"))
    return counts.select("query_id", F.when((F.least(F.col("n"), F.lit(limit)) >= 2) & (F.col("n_ready") >= 2), "compare").otherwise("narrow")
                         .alias("action"))


def clarify_actions(conditions: DataFrame) -> DataFrame:
    """search when the conditions hold a usable signal or a question was already asked, else clarify."""
    def filled(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""

    ready = ((F.size(or_empty("skills")) > 0) | filled("role") | filled("experience") | (F.size(or_empty("must_have")) > 0)
             | (F.size(or_empty("nice_to_have")) > 0))
    for anchor in ("anchor_person", "anchor_name"):
        if anchor in conditions.columns:
            ready = ready | filled(anchor)
    return conditions.select("query_id", F.when(ready | (F.col("clarification_count") >= 1), "search").otherwise("clarify").alias("action"))


def export_confidences(records: DataFrame) -> DataFrame:
    """Confidence of the best exported record of each set against its runner-up.

    records: (query_id, person_id, match_score, n_evidence, n_sources, freshness); scores above 1 are percents, unless ``pct`` gives the percents.
    """
    from ..sources.sinks import export_confidence, outcome_of
    pct = F.when(F.col("match_score") <= 1, F.col("match_score") * 100).otherwise(F.col("match_score"))
    pct = F.col("pct") if "pct" in records.columns else pct
    head = top_k(records.withColumn("pct", pct), ["query_id"], [F.desc("match_score"), "person_id"], 2)
    w = Window.partitionBy("query_id").orderBy("rank")
    lead = head.withColumn("gap", F.col("pct") - F.lead("pct").over(w)).filter("rank = 1")
    confidence = export_confidence(F.col("gap"), F.col("n_evidence"), F.col("n_sources"), F.col("freshness"))
    return lead.select("query_id", "person_id", "gap", confidence.alias("confidence")).withColumn("outcome", outcome_of(F.col("confidence")))
