"""Keyword, vector and hybrid retrieval for tables of queries."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, RetrievalConfig
from ..functions.arrays import expand_family, or_empty, single, unique_lower
from ..functions.similarity import clamp01, trigrams
from ..functions.text import (contains_any, is_boundary_term, is_strong_term, normalize_index_text,
                              normalize_search_text, normalized_contains_any, snippet, trim_ws)
from ..session import stored
from .common import top_k
from .filters import usable_must_haves
from .intent import keyword_query
from .postings import SearchIndex, build_index, filter_columns, meeting_blocks
from .scan import QueryFilters, Rows, TermMatrix, TextTerms, gram_code, meet_top_k, tiled
from .vectors import build_vectors

FLAGS = ["role", "skill", "skill_text", "leadership", "open_source", "code_source", "specialized", "exact_name",
         "prefix_name"]
NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(NONE)


def _strong(terms: Column, limit: int | None = None) -> Column:
    kept = F.filter(F.array_distinct(F.transform(terms, lambda x: normalize_search_text(x))), is_strong_term)
    return F.slice(kept, 1, limit) if limit else kept


def both_languages(places: Column) -> Column:
    families = {name: values for name, values in V.LOCATION_FAMILIES.items()}
    return expand_family(places, families)


def wants_specialized(*parts: Column) -> Column:
    return normalized_contains_any(F.array_join(F.concat(*parts), " "), V.SPECIALIZED_TERMS)


def prepare_queries(intents: DataFrame, cfg: RetrievalConfig = DEFAULT.retrieval, role_families=V.ROLE_FAMILIES,
                    skill_families=V.SKILL_FAMILIES) -> DataFrame:
    """Everything of a query that scoring needs: expanded terms, text terms, flags and filters.

    intents: (query_id, raw_query, roles, skills, locations, must_haves, nice_to_haves, source_bias and
    optionally filter_sources, filter_locations).
    """
    extra_sources = or_empty("filter_sources") if "filter_sources" in intents.columns else _none()
    extra_places = or_empty("filter_locations") if "filter_locations" in intents.columns else _none()
    q = intents.withColumns({
        "exp_roles": expand_family("roles", role_families), "exp_skills": expand_family("skills", skill_families),
        "keyword_query": keyword_query(role_families, skill_families), "norm_query": normalize_search_text("raw_query"),
        "must_terms": F.array_distinct(usable_must_haves(or_empty("must_haves"), cfg.max_must_haves))})
    everything = F.array_join(F.concat(F.array("raw_query"), or_empty("skills"), or_empty("must_haves"), or_empty("nice_to_haves")), " ")
    q = q.withColumns({
        "wants_open": normalized_contains_any(everything, V.OPEN_SOURCE_TERMS),
        "wants_special": wants_specialized(F.array("raw_query"), or_empty("skills"), F.col("exp_skills")),
        "blend_special": wants_specialized(F.array("raw_query"), or_empty("skills"))})
    open_terms = _strong(F.array(*[F.lit(t) for t in V.OPEN_SOURCE_TERMS]))
    return q.withColumns({
        "skill_terms": _strong(F.col("exp_skills"), cfg.max_text_terms),
        "lead_terms": F.when(F.col("wants_open"), _strong(F.col("exp_roles"), cfg.max_text_terms)).otherwise(_none()),
        "open_terms": F.when(F.col("wants_open"), open_terms).otherwise(_none()),
        "want_sources": unique_lower(extra_sources, single("source_bias")),
        "want_places": both_languages(F.concat(or_empty("locations"), extra_places)),
        "must_words": F.filter("must_terms", is_boundary_term),
        "must_phrases": F.filter("must_terms", lambda t: ~is_boundary_term(t)),
        "grams": trigrams("keyword_query")})


def _keyword_scorer(cfg: RetrievalConfig):
    boosts = [cfg.boost_role, cfg.boost_skill, cfg.boost_skill_text, cfg.boost_leadership, cfg.boost_open_source,
              cfg.boost_code_source, cfg.boost_specialized, cfg.boost_exact_name, cfg.boost_prefix_name]
    threshold = cfg.keyword_threshold

    def make(queries):
        filters = QueryFilters(queries)
        grams = TermMatrix([[gram_code(g) for g in q["grams"]] for q in queries], pa.int64())
        facets = {"roles": TermMatrix([q["exp_roles"] for q in queries]), "tags": TermMatrix([q["exp_skills"] for q in queries])}
        texts = {n: TextTerms([q[n] for q in queries]) for n in ("skill_terms", "lead_terms", "open_terms")}
        exact = TermMatrix([[q["norm_query"]] if q["norm_query"] else [] for q in queries])
        prefix = TermMatrix([[q["norm_query"]] if q["norm_query"] and " " not in q["norm_query"] else [] for q in queries])
        code = TermMatrix([[V.CODE_SOURCE] for _ in queries])
        wants_open = np.array([bool(q["wants_open"]) for q in queries])
        wants_special = np.array([bool(q["wants_special"]) for q in queries])
        usable = np.array([bool(q["keyword_query"]) for q in queries])

        def score(rows: Rows):
            row_grams = rows.grams
            shared = grams.overlap(row_grams).astype(np.float64)
            sizes = np.asarray(row_grams.value_lengths(), dtype=np.float64)[:, None]
            total = sizes + grams.needed.astype(np.float64)[None, :] - shared
            sim = np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)
            hit = {n: t.overlap(rows) > 0 for n, t in texts.items()}
            is_code = code.overlap(rows["sources"]) > 0
            flags = [facets["roles"].overlap(rows["roles"]) > 0, facets["tags"].overlap(rows["tags"]) > 0,
                     hit["skill_terms"], hit["lead_terms"], hit["open_terms"], is_code & wants_open,
                     is_code & hit["skill_terms"] & wants_special, exact.overlap(rows["names"]) > 0,
                     prefix.overlap(rows["heads"]) > 0]
            # The code-source flag alone adds score but does not make a row a candidate.
            candidate = (sim > threshold) | np.logical_or.reduce([f for i, f in enumerate(flags) if i != 5])
            candidate &= filters.mask(rows) & usable
            rank, bits = sim.copy(), np.zeros(sim.shape, dtype=np.int32)
            for i, (flag, boost) in enumerate(zip(flags, boosts)):
                rank = rank + flag * boost
                bits |= flag.astype(np.int32) << i
            return np.where(candidate, rank, -np.inf), [sim, bits]

        return max(grams.width, 64), score

    return make


def keyword_hits(prepared: DataFrame, docs: DataFrame | SearchIndex, cfg: RetrievalConfig = DEFAULT.retrieval) -> DataFrame:
    """Top rows per query by the unclamped sum of trigram similarity and boosts, with the flags that fired.

    A row is a candidate when any signal fires and all filters of the query hold. Only active persons count.
    ``docs`` has one row per person, or is the index that ``postings.build_index`` made of such a table.
    """
    index = docs if isinstance(docs, SearchIndex) else build_index(docs)
    queries = stored(prepared, "queries")
    pairs = stored(meeting_blocks(queries, index, cfg.keyword_threshold), "meeting-blocks")
    hits = meet_top_k(index.rows, tiled(queries), pairs, _keyword_scorer(cfg), cfg.limit, {"sim": "double", "flags": "int"})
    return hits.select("query_id", "person_id", "sim", "rank_score", clamp01(F.col("rank_score")).alias("keyword_score"),
                       "rank", *[(F.col("flags").bitwiseAND(F.lit(1 << i)) > 0).alias(f"m_{f}") for i, f in enumerate(FLAGS)])


def _vector_scorer(queries):
    filters = QueryFilters(queries)
    matrix = np.array([q["embedding"] for q in queries], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)

    def score(rows: Rows):
        data = np.asarray(rows["embedding"].flatten(), dtype=np.float64).reshape(len(rows), matrix.shape[1])
        scale = np.linalg.norm(data, axis=1)[:, None] * norms[None, :]
        sim = np.divide(data @ matrix.T, scale, out=np.zeros((len(data), len(matrix))), where=scale > 0)
        return np.where(filters.mask(rows), np.round(sim, 9), -np.inf), [sim]

    return 64, score


def vector_hits(prepared: DataFrame, vectors: DataFrame, docs: DataFrame, embeddings: DataFrame,
                cfg: RetrievalConfig = DEFAULT.retrieval) -> DataFrame:
    """Exact cosine top-k under the same filters; queries without a vector give no rows.

    Rows are ordered by the similarity to nine decimals so equal vectors tie and the id decides; the score itself is not rounded.
    Queries first meet the blocks nearest to them; their k-th best row then tells which of the others can still matter.
    """
    q = prepared.join(vectors.select("query_id", F.col("embedding")).filter(F.size("embedding") > 0), "query_id")
    q = stored(q.withColumn("dim", F.size("embedding")), "query-vectors")
    tested = not q.filter((F.size("must_words") > 0) | (F.size("must_phrases") > 0)).isEmpty()  # texts are read only for must-have terms
    # Texts are normalised after the join, only where there is a vector.
    rows = filter_columns(docs.join(embeddings.select("person_id", "embedding"), "person_id"), tested).select("person_id", "sources", "place_text", "norm", "embedding")
    index = build_vectors(rows)
    queries = tiled(q)
    extra = {"sim": "double"}
    first = stored(meet_top_k(index.rows, queries, index.nearest(q), _vector_scorer, cfg.limit, extra).drop("rank"), "first-vectors")
    further = meet_top_k(index.rows, queries, index.further(q, first, cfg.limit), _vector_scorer, cfg.limit, extra).drop("rank")
    hits = top_k(first.unionByName(further), ["query_id"], [F.desc("rank_score"), "person_id"], cfg.limit)
    return hits.select("query_id", "person_id", clamp01(F.col("sim")).alias("vector_score"), "rank")


def blend_weights(prepared: DataFrame, cfg: RetrievalConfig = DEFAULT.retrieval) -> DataFrame:
    special, biased = F.col("blend_special"), F.col("source_bias").isNotNull()
    return prepared.select(
        "query_id",
        F.when(special & biased, cfg.biased_keyword).when(special, cfg.specialized_keyword).otherwise(cfg.keyword_weight).alias("w_keyword"),
        F.when(special & biased, cfg.biased_vector).when(special, cfg.specialized_vector).otherwise(cfg.vector_weight).alias("w_vector"))


def hybrid_hits(prepared: DataFrame, keyword: DataFrame, vector: DataFrame, cfg: RetrievalConfig = DEFAULT.retrieval) -> DataFrame:
    """Full outer merge of both hit lists per (query, person), blended and cut to the limit.

    With no vector hits for a query the keyword list alone remains, as in the keyword-only fallback.
    """
    k = keyword.select("query_id", "person_id", "keyword_score")
    v = vector.select("query_id", "person_id", "vector_score")
    merged = k.join(v, ["query_id", "person_id"], "full_outer").join(blend_weights(prepared, cfg), "query_id")
    ks, vs = F.coalesce("keyword_score", F.lit(0.0)), F.coalesce("vector_score", F.lit(0.0))
    scored = merged.select("query_id", "person_id", ks.alias("keyword_score"), vs.alias("vector_score"),
                           (ks * F.col("w_keyword") + vs * F.col("w_vector")).alias("combined_score"))
    return top_k(scored, ["query_id"], [F.desc("combined_score"), "person_id"], cfg.limit)


def with_snippets(hits: DataFrame, docs: DataFrame) -> DataFrame:
    return hits.join(docs.select("person_id", snippet("doc_text").alias("matched_text")), "person_id")


def retrieval_warnings(prepared: DataFrame, keyword: DataFrame, vector: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Warning code per query: vector failed, vector empty, or nothing found. ``failed`` lists query ids."""
    k = keyword.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_keyword"))
    v = vector.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_vector"))
    j = prepared.select("query_id").join(k, "query_id", "left").join(v, "query_id", "left")
    bad = F.lit(False)
    if failed is not None:
        j = j.join(failed.select("query_id").distinct().withColumn("_f", F.lit(True)), "query_id", "left")
        bad = F.coalesce("_f", F.lit(False))
    nk, nv = F.coalesce("n_keyword", F.lit(0)), F.coalesce("n_vector", F.lit(0))
    return j.select("query_id", nk.alias("n_keyword"), nv.alias("n_vector"), F.array_compact(F.array(
        F.when(bad, "vector_search_failed"), F.when(~bad & (nv == 0) & (nk > 0), "vector_search_empty"),
        F.when((nk == 0) & (nv == 0), "keyword_search_empty"))).alias("warnings"))


def fallback_score(location_hit: Column, source_hit: Column, role_hit: Column, skill_hits: Column, n_skills: Column,
                   nice_hits: Column, wants_location: Column, wants_source: Column) -> Column:
    """35 + 30 location + 10 source + 15 role + 25 x skill share + up to 10 for nice-to-haves, capped at 100."""
    zero = F.lit(0)
    score = (F.lit(35) + F.when(wants_location & location_hit, 30).otherwise(zero)
             + F.when(wants_source & source_hit, 10).otherwise(zero) + F.when(role_hit, 15).otherwise(zero)
             + F.when(n_skills > 0, F.floor(skill_hits / n_skills * 25 + 0.5)).otherwise(zero)
             + F.least(F.lit(10), nice_hits * 4))
    return F.least(F.lit(100), score).cast("int")


def fallback_hits(docs: DataFrame, *, locations=(), source_bias: str | None = None, must=(), role: str | None = None,
                  skills=(), nice=(), limit: int = 10) -> DataFrame:
    """Rule-scored search for one condition set over all active documents that pass its filters."""
    from ..functions.text import context_term_match
    df = docs.filter("status = 'active'")
    places = [p.lower() for p in locations]
    place_text = F.lower(F.array_join(F.concat(or_empty("facet_location"), single("location")), "\n"))
    place_hit = contains_any(place_text, places) if places else F.lit(False)
    sources = F.transform(or_empty("facet_source"), F.lower)
    source_hit = F.array_contains(sources, source_bias) if source_bias else F.lit(False)
    if places:
        df = df.filter(place_hit)
    if source_bias:
        df = df.filter(source_hit)
    body = F.lower(F.concat_ws("\n", "doc_text", F.array_join(or_empty("facet_tags"), "\n")))
    for term in must:
        family = next((f for f in V.UNIVERSITY_FAMILIES if term.lower() == f[0]), [term])
        df = df.filter(contains_any(body, [t.lower() for t in family]))
    context = F.concat_ws(" ", "name", "headline", "location", "doc_text", F.array_join(or_empty("facet_role"), " "),
                          F.array_join(or_empty("facet_tags"), " "))
    df = df.withColumn("_context", F.lower(context))
    ctx = F.col("_context")

    def hits(terms):
        return sum((F.when(context_term_match(t, ctx), 1).otherwise(0) for t in terms), F.lit(0))

    score = fallback_score(place_hit, source_hit, context_term_match(role, ctx) if role else F.lit(False), hits(skills),
                           F.lit(len(list(skills))), hits(nice), F.lit(bool(places)), F.lit(bool(source_bias)))
    return df.select("person_id", score.alias("score")).orderBy(F.desc("score"), "person_id").limit(limit)


def candidate_label(name: Column, headline: Column, reasons: Column, facet_source: Column) -> Column:
    clean = F.nullif(trim_ws(headline), F.lit(""))
    different = clean.isNotNull() & (normalize_search_text(clean) != normalize_search_text(name))
    label = F.regexp_replace(clean, "^(.{19}).{2,}$", "$1…")
    source = F.get(facet_source, F.lit(0))
    return (F.when(different, label).when(F.array_contains(reasons, "zju manual seed"), "浙大校友 seed")
            .when(F.array_contains(reasons, "zju evidence"), "浙大相关")
            .when(source.isNotNull(), F.concat(F.lit("来源 "), source)).otherwise("画像待区分"))


def disambiguation_notes(candidates: DataFrame) -> DataFrame:
    """Notes for hits of a query sharing a name the query refers to.

    candidates: (query_id, raw_query, person_id, rank, name, headline, reasons, facet_source). Per name group
    only the first three distinct labels are kept, enough to show two others next to any member's own.
    """
    c = candidates.withColumns({"name_norm": normalize_search_text("name"), "query_norm": normalize_search_text("raw_query"),
                                "label": candidate_label(F.col("name"), F.col("headline"), or_empty("reasons"), or_empty("facet_source"))})
    refers = F.contains("query_norm", F.col("name_norm")) | F.contains("name_norm", F.col("query_norm"))
    c = c.filter((F.col("name_norm") != "") & (F.col("query_norm") != "") & refers)
    keys = ["query_id", "name_norm"]
    sizes = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    labels = c.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    head = top_k(labels, keys, ["first", "label"], 3, "slot").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("slot", "label"))), lambda x: x["label"]).alias("_labels"))
    shared = labels.select(*keys, "label", (F.col("n") > 1).alias("_own_repeats"))
    j = c.join(sizes, keys).join(head, keys).join(shared, [*keys, "label"])
    # A member's own label counts among the others only when another member carries it too.
    others = F.slice(F.filter("_labels", lambda x: (x != F.col("label")) | F.col("_own_repeats")), 1, 2)
    tail = F.when(F.size(others) > 0, F.concat(F.lit("；其他还有 "), F.array_join(others, " / "))).otherwise("")
    return j.select("query_id", "person_id", "group_size", F.concat(
        F.lit("重名提示：同名候选共 "), F.col("group_size").cast("string"), F.lit(" 个；当前是 "), F.col("label"), tail, F.lit("。")).alias("note"))
