"""Reranking of retrieved hits: evidence boost, freshness, pair scores, reasons, shortlist orders, profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, DimensionWeights, RankConfig
from ..functions.arrays import or_empty
from ..functions.dates import recency_multiplier, step_recency
from ..functions.text import (blank_to_null, contains_any, has_university_signal, normalize_search_text,
                              normalized_contains_any, snippet, truncate)
from ..session import cut_lineage
from .common import top_k
from .windows import strongest_evidence

KEYS = ["query_id", "person_id"]


def query_wishes(intents: DataFrame) -> DataFrame:
    """Per query: lower-cased skills and roles and which special focuses its words ask for."""
    def text(*names):
        return F.array_join(F.concat(F.array("raw_query"), *[or_empty(n) for n in names]), " ")

    return intents.select(
        "query_id", F.transform(or_empty("skills"), F.lower).alias("skills"), or_empty("roles").alias("roles"),
        or_empty("must_haves").alias("must_haves"),
        normalized_contains_any(text("skills", "must_haves", "nice_to_haves"), V.OPEN_SOURCE_QUERY_TERMS).alias("q_open"),
        normalized_contains_any(text("roles"), V.TECH_LEAD_TERMS).alias("q_lead"),
        normalized_contains_any(text("skills", "must_haves", "nice_to_haves"), V.SPECIALIZED_TERMS).alias("q_special"),
        has_university_signal(text("must_haves", "nice_to_haves")).alias("q_school"))


def _mentioned(skills: Column, text: Column) -> Column:
    return F.filter(skills, lambda s: F.contains(text, s))


def evidence_signals(hits: DataFrame, wishes: DataFrame, evidence: DataFrame, cfg: RankConfig = DEFAULT.rank) -> DataFrame:
    """Evidence of hit persons summed per (query, person).

    Equal items of a person are counted first, so copies cost one row, and only persons among the hits
    are read; the join to the queries is on the hit list, never on all pairs.
    """
    own = evidence.join(hits.select("person_id").distinct(), "person_id", "left_semi")
    numbers = F.coalesce("followers", F.lit(0.0)) if "followers" in evidence.columns else F.lit(0.0)
    if cfg.count_stars and "stars" in evidence.columns:
        numbers = numbers + F.coalesce("stars", F.lit(0.0))
    items = own.select(
        "person_id", "evidence_type", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).alias("raw"),
        F.lower(F.coalesce("language", F.lit(""))).alias("language"), "title", "evidence_id", numbers.alias("followers"))
    items = items.groupBy("person_id", "evidence_type", "raw", "language").agg(
        F.count(F.lit(1)).alias("n"), F.sum("followers").alias("followers"),
        F.min_by("title", "evidence_id").alias("title"), F.min("evidence_id").alias("first_id"))
    items = items.withColumn("text", normalize_search_text("raw")).withColumn("school", F.col("text").contains(V.UNIVERSITY_FAMILIES[0][0]))
    j = hits.select(*KEYS).join(wishes.select("query_id", "skills"), "query_id").join(items, "person_id")
    mentioned = _mentioned(F.col("skills"), F.col("text"))
    j = j.withColumn("found", mentioned)
    match = (F.size("found") > 0) | F.array_contains("skills", F.col("language"))
    project, repo = F.col("evidence_type") == "project", F.col("evidence_type") == "repository"
    titled = project & (F.coalesce("title", F.lit("")) != "")
    return j.groupBy(*KEYS).agg(
        F.sum(F.when(project & match, F.col("n")).otherwise(0)).alias("project_matches"),
        F.sum(F.when(repo & match, F.col("n")).otherwise(0)).alias("repo_matches"),
        F.max(repo).alias("has_repo"), F.max(repo & (F.size("found") > 0)).alias("repo_skill"),
        F.max("school").alias("evidence_school"), F.sum("followers").alias("followers"),
        F.array_distinct(F.flatten(F.collect_set("found"))).alias("evidence_skills"),
        F.min_by("title", F.when(titled, F.col("first_id"))).alias("project_title"))


def score_hits(hits: DataFrame, intents: DataFrame, docs: DataFrame, evidence: DataFrame,
               cfg: RankConfig = DEFAULT.rank, pair_scores: DataFrame | None = None) -> DataFrame:
    """Evidence boost, freshness, heuristic and final score, and the facts reasons are made of.

    hits: (query_id, person_id, keyword_score, vector_score, combined_score). A pair without a pair score
    keeps its heuristic score; missing is not zero.
    """
    # The hit list is small (limit rows per query) and read four times below: store it once.
    hits = cut_lineage(hits)
    wishes = query_wishes(intents)
    signals = evidence_signals(hits, wishes, evidence, cfg)
    shown = docs.join(hits.select("person_id").distinct(), "person_id", "left_semi").select(
        "person_id", "doc_text", "facet_role", "facet_source", "facet_tags", "freshness", normalize_search_text("doc_text").alias("norm_doc"))
    j = hits.join(wishes, "query_id").join(shown, "person_id", "left").join(signals, KEYS, "left")
    is_code = F.coalesce(F.array_contains("facet_source", V.CODE_SOURCE), F.lit(False))
    doc_norm = F.coalesce("norm_doc", F.lit(""))

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))

    skill_doc = F.exists("skills", lambda s: F.contains(doc_norm, s))
    special = F.col("q_special") & is_code & (skill_doc | flag("repo_skill"))
    open_text = contains_any(doc_norm, ["open source", "开源"]) | flag("has_repo")
    role_text = F.concat_ws(" ", normalize_search_text(F.array_join(or_empty("facet_role"), " ")), doc_norm)
    lead = F.col("q_lead") & contains_any(role_text, V.TECH_LEAD_TERMS)
    school = F.col("q_school") & (doc_norm.contains(V.UNIVERSITY_FAMILIES[0][0]) | flag("evidence_school"))
    seed = F.col("q_school") & F.coalesce(F.array_contains("facet_tags", V.SEED_TAG), F.lit(False))
    j = j.withColumns({"f_special": special, "f_lead": lead, "f_school": school, "f_seed": seed,
                       "f_open_source": F.col("q_open") & is_code, "f_open_text": F.col("q_open") & open_text})

    def add(condition, value):
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    boost = (F.coalesce("project_matches", F.lit(0)) * F.lit(cfg.project_match)
             + F.coalesce("repo_matches", F.lit(0)) * F.lit(cfg.repo_match)
             + add(F.col("f_special"), cfg.specialized) + add(F.col("f_special") & flag("has_repo"), cfg.specialized_repo)
             + add(F.col("f_open_source"), cfg.open_source_source) + add(F.col("f_open_text"), cfg.open_source_text)
             + add(F.col("f_lead"), cfg.tech_lead) + add(F.col("f_school"), cfg.university)
             + add(F.col("f_seed"), cfg.university_seed)
             + F.lit(cfg.follower_scale) * F.log10(F.coalesce("followers", F.lit(0.0)) + 1))
    days = F.coalesce("freshness", F.lit(365))
    j = j.withColumns({"evidence_boost": boost,
                       "freshness_factor": F.greatest(F.lit(0.35), F.exp(-days / F.lit(cfg.freshness_decay_days)))})
    heuristic = F.col("combined_score") * (1 + F.col("evidence_boost")) * F.col("freshness_factor")
    j = j.withColumn("heuristic_score", heuristic)
    if pair_scores is None:
        return j.withColumns({"pair_score": F.lit(None).cast("double"), "pair_reason": F.lit(None).cast("string"),
                              "final_score": F.col("heuristic_score")})
    j = j.join(pair_scores, KEYS, "left")
    blended = F.col("heuristic_score") * (1 - cfg.pair_weight) + F.col("pair_score") * cfg.pair_weight
    return j.withColumn("final_score", F.coalesce(blended, F.col("heuristic_score")))


def match_reasons(cfg: RankConfig = DEFAULT.rank) -> Column:
    """Ordered, distinct, at most five. Needs the columns of ``score_hits`` and ``_text``, the normalised snippet."""
    none = F.array().cast("array<string>")

    def named(prefix, items):
        return F.transform(items, lambda x: F.concat(F.lit(prefix), x))

    def one(condition, value):
        return F.when(condition, F.array(F.lit(value) if isinstance(value, str) else value)).otherwise(none)

    roles = F.filter("roles", lambda r: F.exists(or_empty("facet_role"), lambda v: F.contains(v, r)) | F.contains(F.col("_text"), r))
    skills = F.filter("skills", lambda s: F.array_contains(or_empty("facet_tags"), s) | F.array_contains(or_empty("evidence_skills"), s))
    must = F.filter("must_haves", lambda m: F.contains(F.col("_text"), m))
    llm = one((F.col("pair_score") >= 0.5) & (F.coalesce("pair_reason", F.lit("")) != ""), F.concat(F.lit("LLM: "), F.col("pair_reason")))
    parts = [llm, named("role match: ", roles), one(F.col("f_open_source"), "github open-source evidence"),
             one(F.col("f_special"), "github technical evidence"), one(F.col("f_lead"), "tech lead evidence"),
             one(F.col("f_school"), "zju evidence"), one(F.col("f_seed"), "zju manual seed"),
             named("skill evidence: ", skills), named("must-have matched: ", must),
             one(F.col("vector_score") >= cfg.strong_vector, "strong semantic similarity"),
             one(F.col("keyword_score") >= cfg.strong_keyword, "strong keyword overlap"),
             one(F.col("project_title").isNotNull(), F.concat(F.lit("project: "), F.col("project_title")))]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, 5)


def rerank(hits: DataFrame, intents: DataFrame, docs: DataFrame, evidence: DataFrame, cfg: RankConfig = DEFAULT.rank,
           pair_scores: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Ranked hits with scores and reasons; all of them unless ``limit`` says how many."""
    scored = score_hits(hits, intents, docs, evidence, cfg, pair_scores)
    texts = scored.withColumn("_text", normalize_search_text(snippet("doc_text")))
    out = texts.withColumn("match_reasons", match_reasons(cfg))
    return top_k(out, ["query_id"], [F.desc("final_score"), "person_id"], limit)


# --- pair scoring -------------------------------------------------------------------------
def intent_text() -> Column:
    def part(label, name):
        return F.when(F.size(or_empty(name)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(name, ", ")))

    return F.concat_ws("\n", F.concat(F.lit('Query: "'), F.col("raw_query"), F.lit('"')), part("Required roles", "roles"),
                       part("Key skills", "skills"), part("Location preference", "locations"), part("Must have", "must_haves"),
                       part("Nice to have", "nice_to_haves"))


def candidate_texts(persons: DataFrame, docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Short profile text of each person: capped fields, lists of 12, three jobs / projects / repositories, 2000 in all."""
    def cut(c):
        return truncate(c, 200, 199, "…")

    kind = F.col("evidence_type")
    rows = evidence.filter(kind.isin("experience", "project", "repository"))
    newest_first = F.when(kind == "experience", -F.unix_micros("occurred_at")).otherwise(F.lit(0))
    rows = top_k(rows.withColumn("_o", newest_first), ["person_id", "evidence_type"], [F.asc_nulls_last("_o"), "evidence_id"], 3, "slot")
    day = F.when(F.col("occurred_at").isNotNull(), F.concat(F.lit(" ["), F.date_format("occurred_at", "yyyy-MM-dd"), F.lit("]"))).otherwise("")
    job = F.concat(cut(F.coalesce("title", F.lit("Untitled role"))), day, F.lit(": "), cut(F.coalesce("description", F.lit("No description"))))
    project = F.concat(cut(F.coalesce("title", F.lit("Untitled"))), F.lit(": "), cut(F.coalesce("description", F.lit("No description"))))
    stars = F.coalesce("stars", F.lit(0)) if "stars" in evidence.columns else F.lit(0)
    repo = F.concat(cut(F.coalesce("title", F.lit("untitled"))), F.lit(" ("), F.coalesce("language", F.lit("unknown")), F.lit(", "),
                    stars.cast("long").cast("string"), F.lit(" stars)"), F.when(F.col("description").isNotNull(), F.concat(
                        F.lit(" — "), cut(F.col("description")))).otherwise(""))
    line = F.when(kind == "experience", job).when(kind == "project", project).otherwise(repo)
    rows = rows.withColumn("line", line)

    def joined(which, label):
        items = F.transform(F.array_sort(F.collect_list(F.when(kind == which, F.struct("slot", "line")))), lambda x: x["line"])
        return F.when(F.count_if(kind == which) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, "; "))).alias(which)

    parts = rows.groupBy("person_id").agg(joined("experience", "Work history"), joined("project", "Projects"), joined("repository", "Repos"))
    latest = evidence.filter(kind.isin("project", "repository")).groupBy("person_id").agg(F.max("occurred_at").alias("latest_at"))
    d = docs.select("person_id", or_empty("facet_role").alias("roles"), or_empty("facet_tags").alias("skills"))
    j = (persons.select("person_id", "name", "headline", "location").join(d, "person_id", "left").join(parts, "person_id", "left")
         .join(latest, "person_id", "left"))

    def label(prefix, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{prefix}: "), value))

    def listed(prefix, name):
        return F.when(F.size(or_empty(name)) > 0, F.concat(F.lit(f"{prefix}: "), F.array_join(F.slice(name, 1, 12), ", ")))

    text = F.concat_ws("\n", F.concat(F.lit("Name: "), cut(F.coalesce("name", F.lit("Unknown")))),
                       label("Headline", cut(F.nullif("headline", F.lit("")))), label("Location", cut(F.nullif("location", F.lit("")))),
                       listed("Roles", "roles"), listed("Skills", "skills"), "experience", "project", "repository",
                       label("Latest evidence", F.date_format("latest_at", "yyyy-MM-dd")))
    return j.select("person_id", truncate(text, 2000, 1999, "…").alias("candidate_text"))


def pair_candidates(scored: DataFrame, intents: DataFrame, texts: DataFrame, cfg: RankConfig = DEFAULT.rank,
                    request_limit: int = 0) -> DataFrame:
    """The top pairs of each query to hand to a pair scorer; wide enough for every row that can be shown."""
    head = top_k(scored.select(*KEYS, "heuristic_score"), ["query_id"], [F.desc("heuristic_score"), "person_id"],
                 max(cfg.pair_limit, request_limit * 2))
    return head.join(intents.select("query_id", intent_text().alias("intent_text")), "query_id").join(texts, "person_id")


# --- shortlist orders -----------------------------------------------------------------------
def evidence_strength(evidence: DataFrame, now) -> DataFrame:
    """Strength 0..100 from the eight strongest items, type and source variety and the item count."""
    kept = strongest_evidence(evidence, 8)
    content = F.when(blank_to_null("title").isNotNull() | blank_to_null("description").isNotNull(), 2).otherwise(0)
    value = F.col("weight") * recency_multiplier("occurred_at", now) + content
    top = kept.groupBy("person_id").agg(F.sum(value).alias("s"), F.countDistinct("evidence_type").alias("t"),
                                        F.countDistinct("source").alias("c"))
    counts = evidence.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    total = (F.col("s") + F.least(F.lit(12), F.col("t") * 3) + F.least(F.lit(6), F.col("c") * 2) + F.least(F.lit(8), F.col("n")))
    return top.join(counts, "person_id").select("person_id", F.least(F.lit(100), F.floor(total + 0.5)).cast("int").alias("evidence"))


def source_priority(sources: Column, profile_url: Column) -> Column:
    """sources hold display labels."""
    unknown = (F.size(sources) == 0) | (F.get(sources, F.lit(0)) == "Unknown")
    linked = profile_url.isNotNull()
    score = (F.lit(30) + F.when(F.size(sources) > 1, 15).otherwise(0) + F.when(F.array_contains(sources, "GitHub"), 20).otherwise(0)
             + F.when(F.array_contains(sources, "Bonjour"), 15).otherwise(0) + F.when(linked, 10).otherwise(0))
    return F.when(unknown, F.when(linked, 30).otherwise(10)).otherwise(F.least(F.lit(100), score))


def match_signal(score: Column) -> Column:
    finite = ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    scaled = F.when(score <= 1.5, score * 100).otherwise(score)
    return F.when(score.isNull() | ~finite, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)))


def shortlist_signals(candidates: DataFrame, strength: DataFrame, now) -> DataFrame:
    """fresh / source / evidence / match signals and the three composites.

    candidates: (query_id, person_id, match_score, sources, profile_url, latest_evidence_at, last_synced_at)
    """
    j = candidates.join(strength, "person_id", "left").select(
        *KEYS, step_recency("latest_evidence_at", "last_synced_at", now).alias("fresh"),
        source_priority(F.col("sources"), F.col("profile_url")).alias("source"),
        F.coalesce("evidence", F.lit(0)).alias("evidence"), match_signal(F.col("match_score")).alias("match"))
    f, s, e, m = (F.col(c) for c in ("fresh", "source", "evidence", "match"))
    return j.withColumns({"by_fresh": f * 0.75 + e * 0.15 + m * 0.1, "by_source": s * 0.7 + f * 0.15 + e * 0.1 + m * 0.05,
                          "by_evidence": e * 0.72 + f * 0.16 + s * 0.07 + m * 0.05})


def state_order_score(match_score: Column, source_ok: Column, wants_source: Column, prefer_fresh: Column, age: Column) -> Column:
    """Overall order: match plus source and freshness bonuses when the conditions ask for them."""
    fresh = F.when(age <= 7, 20).when(age <= 30, 12).when(age <= 90, 5).otherwise(0)
    return (match_score * 100 + F.when(wants_source & source_ok, 18).otherwise(0)
            + F.when(prefer_fresh & age.isNotNull(), fresh).otherwise(0))


# --- six-dimension profile ---------------------------------------------------------------------
def dimension_profiles(persons: DataFrame, evidence: DataFrame, *, skills=(), locations=(), role: str | None = None,
                       experience: str | None = None, weights: DimensionWeights = DEFAULT.dimensions) -> DataFrame:
    """Rule scores per person for one condition set; model-scored dimensions use the no-model defaults.

    Skill mentions are found per distinct text and reduced with max per skill, so evidence is never
    gathered into one row.
    """
    import re
    kind = F.col("evidence_type")
    wanted = list(skills)
    texts = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("null")), F.coalesce("description", F.lit(""))))
    found = [F.max(F.contains(texts, F.lit(s.lower()))).alias(f"_s{i}") for i, s in enumerate(wanted)]
    e = evidence.groupBy("person_id").agg(
        F.count_if(kind == "experience").alias("n_experience"), F.count_if(kind == "repository").alias("n_repo"),
        F.count_if(kind.isin("social", "repository")).alias("n_social"),
        F.count_if(kind.isin("experience", "project", "education")).alias("n_career"), *found)
    j = persons.join(e, "person_id", "left")
    for n in ("n_experience", "n_repo", "n_social", "n_career"):
        j = j.withColumn(n, F.coalesce(n, F.lit(0)))
    head, place = F.lower(F.coalesce("headline", F.lit(""))), F.lower(F.coalesce("location", F.lit("")))
    context = F.concat_ws(" ", head, F.lower(F.coalesce("summary", F.lit(""))))
    if wanted:
        hit = sum(((F.coalesce(F.col(f"_s{i}"), F.lit(False)) | head.contains(s.lower())).cast("int") for i, s in enumerate(wanted)), F.lit(0))
        tech = F.least(F.lit(100.0), 40 + hit / len(wanted) * 60)
    else:
        tech = F.lit(80.0)
    near = F.lit(not locations)
    for loc in locations:
        near = near | place.contains(loc.lower()) | F.contains(F.lit(loc.lower()), place)
    stability = (F.when(F.col("n_experience") == 0, 70).when(contains_any(head, ["senior", "lead", "expert"]), 90)
                 .when(contains_any(head, ["junior", "intern"]), 50).otherwise(80))
    community = F.least(F.lit(100), F.least(F.lit(100), 30 + F.col("n_social") * 10) + 5)
    project = F.least(F.lit(80), 40 + F.col("n_repo") * 5)
    bonus = F.lit(0)
    if experience:
        level = experience.lower()
        if any(w in level for w in ("senior", "高级", "资深", "lead", "专家")):
            bonus = bonus + F.when(contains_any(context, ["senior", "高级", "资深", "lead", "principal", "专家"]), 15).otherwise(0)
        if any(w in level for w in ("junior", "初级", "实习")):
            bonus = bonus + F.when(contains_any(context, ["junior", "初级", "intern"]), 15).otherwise(0)
        years = re.search(r"(\d+)", level)
        if years and int(years.group(1)) > 0:
            bonus = bonus + F.when(F.col("n_career") >= int(years.group(1)) * 0.7, 10).otherwise(0)
    if role:
        words = F.split(context, r"[\s,.'\"\-_—\\/|]+")
        bonus = bonus + F.when(F.array_contains(words, role.lower()), 15).otherwise(0)
    bonus = F.least(F.lit(weights.experience_cap), bonus)
    j = j.select("person_id", tech.alias("tech"), F.when(near, 100).otherwise(20).alias("location_match"), stability.alias("stability"),
                 project.alias("project"), F.lit(40).alias("academic"), community.alias("community"), bonus.alias("experience_bonus"))
    total = (F.col("tech") * weights.tech + F.col("project") * weights.project + F.col("academic") * weights.academic
             + F.col("stability") * weights.stability + F.col("community") * weights.community
             + F.col("location_match") * weights.location)
    return j.withColumn("overall", F.least(F.lit(100.0), total + F.col("experience_bonus")))

