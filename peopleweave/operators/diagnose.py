"""Search attempt reports, failure codes, recovery and stop decisions - one row per query."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import or_empty
from .aggregates import audit_totals, filter_dropoff, score_distribution, source_spread, strength_histogram

# Failure codes in rule order with their kind, and the order a primary code is chosen in.
RULES = [("intent_anchor_missing", "actionable"), ("intent_missing_role_axis", "actionable"), ("intent_missing_skill_axis", "actionable"),
         ("retrieval_zero_hits", "actionable"), ("filter_too_strict", "actionable"), ("source_bias_conflict", "diagnostic"),
         ("query_too_broad", "diagnostic"), ("source_coverage_gap", "diagnostic"), ("retrieval_all_weak", "actionable"),
         ("condition_mismatch_dominant", "actionable"), ("evidence_too_sparse", "diagnostic"), ("recovery_budget_exhausted", "terminal")]
PRIORITY = ["intent_anchor_missing", "intent_missing_role_axis", "intent_missing_skill_axis", "filter_too_strict",
            "condition_mismatch_dominant", "retrieval_zero_hits", "retrieval_all_weak"]
BOUNDARY = ["source_coverage_gap", "query_too_broad", "source_bias_conflict"]


def attempt_reports(attempts: DataFrame, hits: DataFrame, audit: DataFrame, failed: DataFrame, min_met: int = 1,
                    min_ratio: float = 1 / 3, bounded: bool = True) -> DataFrame:
    """Everything known about one search attempt per query.

    attempts: (query_id, role, skills, must_have, locations, experience, source_bias, anchor_name, anchor_status,
    clarify_used, clarify_limit, rewrite_used, rewrite_limit, unrestricted_count). ``failed`` holds the failed
    filters of retrieved rows (query_id, failed).
    """
    j = attempts
    for part in (strength_histogram(hits), score_distribution(hits, bounded), audit_totals(audit).withColumnRenamed("total", "audit_total")
                 .drop("unknown"), source_spread(hits), filter_dropoff(failed).withColumnRenamed("exclude", "drop_exclude")
                 .withColumnRenamed("must_have", "drop_must_have").withColumnRenamed("source_bias", "drop_source_bias")):
        j = j.join(part, "query_id", "left")
    n = F.coalesce("total", F.lit(0))
    met, audited = F.coalesce("met", F.lit(0)), F.coalesce("audit_total", F.lit(0))
    drops = sum((F.coalesce(f"drop_{c}", F.lit(0)) for c in ("must_have", "exclude", "source_bias")), F.lit(0))
    named = F.coalesce("anchor_name", F.lit("")) != ""
    role, skill = F.col("role").isNotNull(), (F.size(or_empty("skills")) + F.size(or_empty("must_have"))) > 0
    signals = sum((c.cast("int") for c in (role | named, skill, F.size(or_empty("locations")) > 0, F.col("experience").isNotNull(),
                                           F.col("source_bias").isNotNull(), named)), F.lit(0))
    j = j.withColumns({"hits": n, "zero_hits": n == 0, "all_weak": (n > 0) & (F.coalesce("weak", F.lit(0)) == n), "drops": drops,
                       "has_role": role, "has_skill": skill, "signals": signals,
                       "mismatch": F.when(audited == 0, True).otherwise((met < min_met) | (met / audited < min_ratio)),
                       "budget_used": (F.col("clarify_used") >= F.col("clarify_limit")) & (F.col("rewrite_used") >= F.col("rewrite_limit"))})
    # With no hits there are no reasons to be thin, so sparse evidence needs at least one hit.
    return j.withColumns({"sparse": F.coalesce(F.col("all_thin"), F.lit(False)) & F.col("all_weak"),
                          "gap_suspected": (F.col("hits") < 3) & (F.coalesce("unrestricted_count", F.lit(0)) < 5),
                          "usable": (F.col("hits") > 0) & ~F.col("all_weak")})


def failure_reports(reports: DataFrame) -> DataFrame:
    """Failure codes that fired, the primary actionable one and how each may be used."""
    zero, weak = F.col("zero_hits"), F.col("all_weak")
    flat = (F.col("hits") >= 3) & (F.coalesce("gap", F.lit(1.0)) <= 0.03) & ((F.coalesce("max", F.lit(0.0)) - F.coalesce("min", F.lit(0.0))) <= 0.08)
    fired = {
        "intent_anchor_missing": F.coalesce(F.col("anchor_status").isin("not_found", "ambiguous"), F.lit(False)),
        "intent_missing_role_axis": ~F.col("has_role") & (zero | weak), "intent_missing_skill_axis": ~F.col("has_skill") & (zero | weak),
        "retrieval_zero_hits": zero, "filter_too_strict": zero & (F.col("drops") > 0),
        "source_bias_conflict": F.col("source_bias").isNotNull() & (F.coalesce("unrestricted_count", F.lit(0)) > 0)
        & (F.coalesce("dominant", F.lit("unknown")) == "source_bias"),
        "query_too_broad": weak & flat, "source_coverage_gap": zero & F.col("gap_suspected"), "retrieval_all_weak": weak,
        "condition_mismatch_dominant": F.col("mismatch"), "evidence_too_sparse": F.col("sparse"),
        "recovery_budget_exhausted": F.col("budget_used")}

    def codes(kind=None):
        return F.array_compact(F.array(*[F.when(fired[c], F.lit(c)) for c, k in RULES if kind in (None, k)]))

    both = fired["intent_missing_role_axis"] & fired["intent_missing_skill_axis"]
    primary = F.coalesce(F.when(fired["intent_anchor_missing"], "intent_anchor_missing"), F.when(both, "intent_missing_role_axis"),
                         *[F.when(fired[c], F.lit(c)) for c in PRIORITY])
    keep = ["query_id", "hits", "usable", "clarify_used", "clarify_limit", "rewrite_used", "rewrite_limit"]
    return reports.select(*keep, codes().alias("codes"), codes("actionable").alias("actionable"), codes("diagnostic").alias("diagnostic"),
                          codes("terminal").alias("terminal"), primary.alias("primary_code"))


def recovery_actions(failures: DataFrame) -> DataFrame:
    """clarify, rewrite, a low-confidence shortlist, or stop."""
    p = F.col("primary_code")
    can_ask, can_rewrite = F.col("clarify_used") < F.col("clarify_limit"), F.col("rewrite_used") < F.col("rewrite_limit")
    exhausted = F.size("terminal") > 0
    last = F.when(F.col("hits") > 0, "low_confidence_shortlist").otherwise("stop")
    asks = p.isin("intent_anchor_missing", "intent_missing_role_axis", "intent_missing_skill_axis")
    rewrites = p.isin("condition_mismatch_dominant", "filter_too_strict", "retrieval_zero_hits", "retrieval_all_weak")
    action = (F.when(exhausted, last).when(asks, F.when(can_ask, "clarify").when(can_rewrite, "rewrite").otherwise(last))
              .when(rewrites, F.when(can_rewrite, "rewrite").otherwise(last)).otherwise(last))
    prompt = F.when(action == "clarify", F.when(p == "intent_anchor_missing", "anchor").when(p == "intent_missing_role_axis", "role")
                    .otherwise("skill"))
    return failures.select("query_id", action.alias("action"), F.when(action.isin("clarify", "rewrite"), p).alias("target"), prompt.alias("prompt"))


def boundary_codes(failures: DataFrame) -> DataFrame:
    return failures.select("query_id", F.coalesce(*[F.when(F.array_contains("diagnostic", c), F.lit(c)) for c in BOUNDARY]).alias("boundary"))


def corpus_gaps(counts: DataFrame) -> DataFrame:
    """counts: (query_id, hits, unrestricted_count, drops, drop_known). Gap suspicion and the signals behind it."""
    zero = F.col("hits") == 0
    signals = F.array_compact(F.array(
        F.when(zero & (F.col("drops") == 0), "no dominant hard-filter dropoff detected"),
        F.when(zero & (F.col("unrestricted_count") == 0), "unrestricted retrieval also returned zero candidates"),
        F.when(zero & ~F.col("drop_known"), "post-retrieval dropoff attribution unavailable")))
    return counts.select("query_id", ((F.col("hits") < 3) & (F.coalesce("unrestricted_count", F.lit(0)) < 5)).alias("suspected"), signals.alias("signals"))


def stop_decisions(rounds: DataFrame, floor: int = 3, cap: int = 4, top_n: int = 3) -> DataFrame:
    """Stop rule per (query, round) from list sizes and how many of the top are new since the round before.

    rounds: (query_id, round, shortlist array, compare_size). A query has at most a few rounds.
    """
    w = Window.partitionBy("query_id").orderBy("round")
    top = F.slice("shortlist", 1, top_n)
    j = rounds.withColumn("_top", top).withColumn("_before", F.lag("_top").over(w))
    new = F.size(F.array_except("_top", F.coalesce("_before", F.array_except("_top", "_top"))))
    j = j.withColumn("new_top", new)
    n, r, fresh = F.size("shortlist"), F.col("round"), F.col("new_top")
    reason = (F.when(r < floor, None).when(F.col("compare_size") >= 2, "enough_compare").when((n >= 4) & (fresh <= 1), "enough_shortlist")
              .when((n >= 3) & (fresh == 0), "low_marginal_gain").when((r >= cap) | (n < 3) | (fresh >= 2), "needs_user_clarification"))
    state = F.when(r < floor, "exploration_floor_not_met").when(F.col("reason") == "needs_user_clarification", "clarification_blocked").otherwise(
        "reportable_not_final")
    level = (F.when(r < floor, F.when((F.col("compare_size") >= 2) | (n >= 3), "medium").otherwise("low"))
             .when(F.col("reason").isin("enough_compare", "enough_shortlist"), "medium").otherwise("low"))
    return j.withColumn("reason", reason).select("query_id", "round", "new_top", "reason", state.alias("assessment"), level.alias("confidence"))

