"""Daily list job: viewer events and candidate pool to a short list per viewer."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, Config
from ..operators import aggregates, goals, opportunities, windows
from ..session import cut_lineage


def run_daily(persons: DataFrame, docs: DataFrame, evidence: DataFrame, events: DataFrame, goal_texts: DataFrame, now,
              cfg: Config = DEFAULT, directions=V.DIRECTIONS, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs: (person_id, doc_updated_at, facet_tags, facet_source, freshness). ``surfaced`` rows are appended to the
    event table so tomorrow's state knows them; ``history`` is that table where ``events`` holds only what viewers did themselves."""
    pool = cut_lineage(windows.candidate_pool(persons, docs, cfg.opportunity).select("person_id", "facet_source", "freshness"))
    own = evidence.join(pool.select("person_id"), "person_id", "left_semi")
    texts = goals.direction_texts(persons.join(pool.select("person_id"), "person_id", "left_semi"), own)
    profiles = goals.direction_profiles(pool, texts, goals.direction_signals(texts, directions), directions)
    facts = opportunities.candidate_facts(pool, own, profiles)
    models = goals.goal_models(events, goal_texts, directions)
    scored = opportunities.score_opportunities(models, facts, aggregates.candidate_state(events if history is None else history, now), cfg.opportunity, directions)
    # Equal totals have to tie whatever order they were summed in.
    listed = cut_lineage(opportunities.curate(scored.withColumn("total", F.round("total", 9)), cfg.opportunity))
    return {"list": listed, "goals": models, "drift": opportunities.drift_notes(models), "buckets": aggregates.bucket_counts(listed),
            "surfaced": opportunities.surfaced_events(listed, now)}
