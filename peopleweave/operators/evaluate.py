"""Search quality: precision, coverage, regression checks, policy acceptance."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compare import clarify_actions, outcomes, post_search_actions
from .joins import judged


def evaluate(queries: DataFrame, results: DataFrame, golden: DataFrame) -> DataFrame:
    """P@5/10/20 (divided by k however few results there are), coverage and first position per query.

    Queries without results or without judgements score zero and position -1.
    """
    j = judged(results, golden)
    hit = F.col("relevant")
    per = j.groupBy("query_id").agg(
        *[(F.count_if(hit & (F.col("rank") <= k)) / k).alias(f"p{k}") for k in (5, 10, 20)], F.max(hit).alias("covered"),
        F.min(F.when(hit, F.col("rank"))).alias("position"))
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id", *[F.coalesce(f"p{k}", F.lit(0.0)).alias(f"p{k}") for k in (5, 10, 20)], F.coalesce("covered", F.lit(False)).alias("covered"),
        F.coalesce("position", F.lit(-1)).alias("position"))


def summarize(evaluated: DataFrame) -> DataFrame:
    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    return evaluated.agg(F.count(F.lit(1)).alias("queries"), *[mean(f"p{k}").alias(f"avg_p{k}") for k in (5, 10, 20)],
                         mean(F.col("covered").cast("double")).alias("coverage"))


def regression_checks(checks: DataFrame, results: DataFrame, label: str = "GitHub") -> DataFrame:
    """Pass or fail per check. checks: (query_id, check, top_n, value); results: (query_id, rank, sources).

    Checks: min_results, min_code_in_top, all_top_include_code.
    """
    depth = checks.select("query_id", "top_n").distinct()
    has = F.array_contains("sources", label)
    sizes = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    tops = depth.join(results, "query_id").groupBy("query_id", "top_n").agg(F.count_if(has & (F.col("rank") <= F.col("top_n"))).alias("n_code"))
    j = checks.join(sizes, "query_id", "left").join(tops, ["query_id", "top_n"], "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("n_code", F.lit(0))
    ok = (F.when(F.col("check") == "min_results", n >= F.col("value")).when(F.col("check") == "min_code_in_top", c >= F.col("value"))
          .when(F.col("check") == "all_top_include_code", c >= F.least(F.col("top_n").cast("long"), n)))
    return j.select("query_id", "check", n.alias("results"), c.alias("code_in_top"), ok.alias("passed"))


def policy_acceptance(fixtures: DataFrame, candidates: DataFrame, assessed: DataFrame) -> DataFrame:
    """Expected against actual clarify action, post-search action and recommendation mode per fixture."""
    j = (fixtures.join(clarify_actions(fixtures).withColumnRenamed("action", "clarify"), "query_id")
         .join(post_search_actions(candidates).withColumnRenamed("action", "post"), "query_id", "left")
         .join(outcomes(assessed).select("query_id", F.col("mode")), "query_id", "left"))
    mode = F.when(F.col("post") == "compare", F.col("mode"))
    ok = ((F.col("clarify") == F.col("expected_clarify"))
          & (F.col("expected_post").isNull() | F.col("post").isNull() | (F.col("post") == F.col("expected_post")))
          & (F.col("expected_mode").isNull() | F.col("post").isNull() | F.coalesce(mode == F.col("expected_mode"), F.lit(False))))
    return j.select("query_id", "clarify", "post", mode.alias("mode"), ok.alias("passed"))
