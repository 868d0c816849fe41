"""Search job: query table in, ranked cards with reasons, warnings and diagnosis inputs out."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, Config
from ..functions.udfs import overlap_scorer, score_pairs
from ..operators import explain, intent, rank, retrieve
from ..session import cut_lineage


def run_search(queries: DataFrame, persons: DataFrame, docs: DataFrame, embeddings: DataFrame, evidence: DataFrame,
               vectors: DataFrame, cfg: Config = DEFAULT, vocabularies: dict | None = None, pair_scorer=None, intents: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs carry the person columns needed for filtering (name, headline, location, status) and must come
    from a read path that already honours opt-outs (``memory.searchable_persons``).

    The whole query table runs as one job. ``intents`` are given where queries have been understood already. With ``pair_scorer=True`` the default scorer, or with a factory that
    scorer, is applied to the head of each list; unscored rows keep their heuristic score.
    """
    intents = intent.tag_intents(queries, **(vocabularies or {})) if intents is None else intents
    prepared = retrieve.prepare_queries(intents, cfg.retrieval)
    keyword = cut_lineage(retrieve.keyword_hits(prepared, docs, cfg.retrieval))
    vector = cut_lineage(retrieve.vector_hits(prepared, vectors, docs, embeddings, cfg.retrieval))
    hits = cut_lineage(retrieve.hybrid_hits(prepared, keyword, vector, cfg.retrieval).drop("rank"))
    scores = None
    if pair_scorer:
        scored = rank.score_hits(hits, intents, docs, evidence, cfg.rank)
        texts = rank.candidate_texts(docs, docs.select("person_id", "facet_role", "facet_tags"), evidence)
        pairs = rank.pair_candidates(scored, intents, texts, cfg.rank)
        scores = score_pairs(pairs, overlap_scorer if pair_scorer is True else pair_scorer)
    ranked = cut_lineage(rank.rerank(hits, intents, docs, evidence, cfg.rank, scores, cfg.retrieval.limit))
    named = ranked.select("query_id", "person_id", "rank", "match_reasons", "facet_source").join(
        persons.select("person_id", "name", "headline"), "person_id").join(intents.select("query_id", "raw_query"), "query_id")
    notes = retrieve.disambiguation_notes(named.withColumnRenamed("match_reasons", "reasons"))
    cards = explain.result_cards(ranked, persons, evidence, notes)
    return {"intents": intents, "ranked": ranked, "cards": cards,
            "retrieval_warnings": retrieve.retrieval_warnings(prepared, keyword, vector),
            "result_warnings": explain.result_warnings(intents, cards)}
