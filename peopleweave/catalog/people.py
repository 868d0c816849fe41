"""Queries for the goal model, daily list, comparison, diagnostics, memory, claims and evaluation."""
from pyspark.sql import functions as F

from ..bindings import EVENT_NOW, NOW, Tables, half, with_sql
from ..operators import aggregates as agg
from ..operators import compare, diagnose, evaluate, explain, goals, memory, opportunities, rank, windows
from ..operators.normalize import normalize_conditions
from ..session import cut_lineage
from .aggregates import AUDIT, HITS, STATE, attempt_audit, attempt_hits
from .evidence_index import DIRECTIONS, FACETS
from .normalisation import COND_SQL, conditions
from .registry import query
from .search import RETRIEVE

ORD = "CASE tag WHEN 'ai_agents' THEN 0 WHEN 'robotics' THEN 1 WHEN 'open_source' THEN 2 ELSE 3 END"


def goal_texts(t: Tables):
    """Each viewer's stated goal, search and exclusion, from the segment of the customer with the same number."""
    c = t.raw("customer").select(F.col("c_custkey").alias("viewer_id"), F.lower("c_mktsegment").alias("seg"))
    rows = c.select("viewer_id", F.explode(F.array(
        F.struct(F.lit("explicit_goal").alias("signal_group"), F.concat(F.lit("a new "), F.col("seg")).alias("text")),
        F.struct(F.lit("search_history").alias("signal_group"), F.when(F.col("viewer_id") % 2 == 0, "gear and ring").otherwise("").alias("text")),
        F.struct(F.lit("excluded").alias("signal_group"), F.when(F.col("viewer_id") % 3 == 0, "no promo please").otherwise("").alias("text")))).alias("x"))
    viewers = t.viewer_events().select("viewer_id").distinct()
    return rows.select("viewer_id", "x.*").join(viewers, "viewer_id", "left_semi")


def goal_models(t: Tables):
    return goals.goal_models(t.viewer_events(), goal_texts(t), DIRECTIONS)


GOALS = f"""gs AS (SELECT DISTINCT viewer_id, g, tag FROM (
    SELECT viewer_id, CASE WHEN kind IN ('interested', 'not_interested', 'contacted') THEN 'feedback' ELSE 'interaction' END AS g, unnest(tags) AS tag FROM viewer_events
    UNION ALL SELECT c_custkey, 'explicit_goal', 'education' FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
    UNION ALL SELECT c_custkey, 'search_history', unnest(['ai_agents', 'robotics']) FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'excluded', 'open_source' FROM customer WHERE c_custkey % 3 = 0) WHERE viewer_id IN (SELECT viewer_id FROM viewer_events)),
cnt AS (SELECT viewer_id, list(tag ORDER BY n DESC, tag) AS dominant FROM (SELECT viewer_id, tag, count(*) AS n FROM gs WHERE g <> 'excluded' GROUP BY 1, 2) GROUP BY 1),
sets AS (SELECT viewer_id, coalesce(list(DISTINCT tag) FILTER (g = 'explicit_goal'), []) AS explicit, coalesce(list_sort(list(DISTINCT tag) FILTER (g NOT IN ('explicit_goal', 'excluded'))), []) AS recent,
  coalesce(list(DISTINCT tag) FILTER (g = 'excluded'), []) AS negative FROM gs GROUP BY 1),
goal AS (SELECT v.viewer_id, coalesce(dominant, []) AS dominant, coalesce(explicit, []) AS explicit, coalesce(recent, []) AS recent, coalesce(negative, []) AS negative,
  CASE WHEN coalesce(length(explicit), 0) = 0 OR coalesce(length(recent), 0) = 0 THEN 'unknown' WHEN length(list_intersect(explicit, recent)) > 0 THEN 'aligned' ELSE 'shifting' END AS drift
  FROM (SELECT DISTINCT viewer_id FROM viewer_events) v LEFT JOIN cnt USING (viewer_id) LEFT JOIN sets USING (viewer_id))"""


@query("gol1_goal_model", with_sql(["viewer_events"], "SELECT viewer_id, dominant, explicit, recent, negative, drift FROM goal", GOALS))
def gol1(t: Tables):
    return goal_models(t).select("viewer_id", "dominant", "explicit", F.array_sort("recent").alias("recent"), "negative", "drift")


@query("gol1_drift_notes", with_sql(["viewer_events"], "SELECT viewer_id, drift, drift = 'shifting' AS noted FROM goal", GOALS))
def gol1_notes(t: Tables):
    return opportunities.drift_notes(goal_models(t)).select("viewer_id", "drift", F.col("note").isNotNull().alias("noted"))


def pool(t: Tables):
    """Daily pool: newest documents of shown persons, with direction profiles of the same persons."""
    docs = t.search_docs().select("person_id", F.col("updated_at").alias("doc_updated_at"), "facet_tags", "facet_source", "freshness")
    p = cut_lineage(windows.candidate_pool(t.persons(), docs).select("person_id", "facet_source", "freshness"))
    texts = goals.direction_texts(t.persons().join(p.select("person_id"), "person_id", "left_semi"), t.evidence().join(p.select("person_id"), "person_id", "left_semi"))
    profiles = goals.direction_profiles(p, texts, goals.direction_signals(texts, DIRECTIONS), DIRECTIONS)
    return opportunities.candidate_facts(p, t.evidence(), profiles)


def scored(t: Tables):
    state = agg.candidate_state(t.all_viewer_events(), EVENT_NOW)
    return opportunities.score_opportunities(goal_models(t), pool(t), state, directions=DIRECTIONS)


POOL = f"""pool AS (SELECT person_id, facet_source, freshness FROM persons p JOIN (SELECT person_id, facet_source, freshness, updated_at AS u FROM search_docs) USING (person_id) WHERE p.status <> 'hidden' ORDER BY u DESC, person_id LIMIT 60),
prof AS (SELECT person_id, coalesce(tags, []) AS tags, CASE WHEN length(tags) >= 2 AND ns >= 2 THEN 'high' WHEN length(tags) >= 1 THEN 'medium' ELSE 'low' END AS pc, coalesce(has_repo, FALSE) AS has_repo, coalesce(has_project, FALSE) AS has_project, facet_source, freshness
  FROM pool LEFT JOIN (SELECT person_id, list(tag ORDER BY {ORD}) AS tags FROM (SELECT DISTINCT person_id, tag FROM sig) GROUP BY 1) USING (person_id) LEFT JOIN (SELECT person_id, count(DISTINCT source) AS ns FROM sig GROUP BY 1) USING (person_id)
  LEFT JOIN (SELECT person_id, bool_or(evidence_type = 'repository') AS has_repo, bool_or(evidence_type = 'project') AS has_project FROM evidence GROUP BY 1) USING (person_id)),
pair AS (SELECT g.*, prof.*, s.* EXCLUDE (viewer_id, person_id), CAST(floor((epoch_us(TIMESTAMP '{EVENT_NOW}') - epoch_us(last_surfaced_at)) / 86400000000) AS BIGINT) AS days,
    list_filter(tags, lambda x: contains(explicit, x) OR contains(dominant[1:3], x) OR contains(recent, x)) AS overlap, length(list_filter(tags, lambda x: contains(negative, x))) AS neg
  FROM goal g CROSS JOIN prof LEFT JOIN state s ON s.viewer_id = g.viewer_id AND s.person_id = prof.person_id),
dirs AS (SELECT *, greatest(0.0, least(1.0, list_sum([0.0] || list_transform(overlap, lambda x: contains(dominant[1:3], x)::INT * 0.34 + contains(explicit, x)::INT * 0.22 + contains(recent, x)::INT * 0.12))
    + CASE WHEN length(overlap) = 0 AND length(tags) > 0 THEN 0.05 ELSE 0 END + CASE pc WHEN 'high' THEN 0.08 WHEN 'medium' THEN 0.03 ELSE 0 END - neg * 0.25))::DOUBLE AS direction FROM pair),
parts AS (SELECT *, CASE WHEN contains(facet_source, 'bonjour') THEN 1.0 WHEN contains(facet_source, 'github') AND has_repo THEN 0.72 WHEN has_project THEN 0.62 WHEN length(facet_source) > 0 THEN 0.5 ELSE 0.35 END::DOUBLE AS reach,
    CASE WHEN seen_count IS NULL THEN 0.5 WHEN last_feedback = 'not_interested' THEN 0 WHEN last_feedback = 'interested' THEN 1 ELSE least(1.0, 0.35 + least(detail_count, 3) * 0.18 + least(repeat_count, 3) * 0.22) END::DOUBLE AS engage,
    exp(-freshness / 180.0::DOUBLE) AS fresh, least(1.0, neg * 0.18)::DOUBLE AS penalty FROM dirs),
opp AS (SELECT *, round(greatest(0.0, least(1.0, direction * 0.72::DOUBLE + CASE WHEN direction < 0.2 THEN least(fresh * 0.1::DOUBLE + reach * 0.08::DOUBLE + engage * 0.05::DOUBLE, 0.18::DOUBLE) ELSE fresh * 0.1::DOUBLE + reach * 0.08::DOUBLE + engage * 0.05::DOUBLE END - penalty)), 9) AS total FROM parts)"""
OPP_NEED = ["persons", "search_docs", "evidence", "viewer_events", "all_viewer_events"]
OPP = STATE + "," + FACETS.split("texts AS", 1)[0].split("loc AS", 1)[0] + "texts AS" + FACETS.split("texts AS", 1)[1] + "," + GOALS + "," + POOL


@query("opp1_direction_match", with_sql(OPP_NEED, "SELECT viewer_id, person_id, overlap AS overlap_tags, neg AS negative_overlap, round(direction, 9) AS direction FROM opp", OPP))
def opp1(t: Tables):
    return scored(t).select("viewer_id", "person_id", "overlap_tags", "negative_overlap", F.round("direction", 9).alias("direction"))


@query("opp2_reach_engagement", with_sql(OPP_NEED, "SELECT viewer_id, person_id, reach AS reachability, round(engage, 9) AS engagement, 0.0::DOUBLE AS revisit FROM opp", OPP))
def opp2(t: Tables):
    return scored(t).select("viewer_id", "person_id", "reachability", F.round("engagement", 9).alias("engagement"), "revisit")


@query("opp3_total_score", with_sql(OPP_NEED, "SELECT viewer_id, person_id, total FROM opp", OPP))
def opp3(t: Tables):
    return scored(t).select("viewer_id", "person_id", F.round("total", 9).alias("total"))


@query("opp4_buckets", with_sql(OPP_NEED, """
SELECT viewer_id, person_id, confidence, CASE WHEN confidence = 'high' AND direction >= 0.45 AND total >= 0.58 THEN 'high-confidence' WHEN coalesce(seen_count, 0) = 0 THEN 'new' ELSE 'needs-validation' END AS bucket FROM (
SELECT *, CASE WHEN direction >= 0.55 AND pc = 'high' AND neg = 0 AND length(tags) > 0 AND length(overlap) > 0 THEN 'high' WHEN direction >= 0.24 AND pc <> 'low' THEN 'medium' ELSE 'low' END AS confidence FROM opp)""", OPP))
def opp4(t: Tables):
    return scored(t).select("viewer_id", "person_id", "confidence", "bucket")


LIST_SQL = """listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY total DESC, person_id) AS rank FROM opp
  WHERE contacted_at IS NULL AND coalesce(last_feedback, '') <> 'contacted' AND NOT (coalesce(last_feedback, '') = 'not_interested' AND total < 0.75)
    AND NOT (coalesce(days < 1, FALSE) AND coalesce(last_feedback, '') <> 'revisit' AND total < 0.78)) WHERE rank <= 7)"""


def listed(t: Tables):
    return opportunities.curate(scored(t).withColumn("total", F.round("total", 9)))


@query("opp5_daily_list", with_sql(OPP_NEED, "SELECT viewer_id, rank, person_id, CASE WHEN rank <= 3 THEN 'top' ELSE 'more' END AS section FROM listed", OPP + "," + LIST_SQL))
def opp5(t: Tables):
    return listed(t).select("viewer_id", "rank", "person_id", "section")


@query("opp6_surfaced_events", with_sql(OPP_NEED, f"SELECT viewer_id, person_id, 'surfaced' AS kind, TIMESTAMP '{EVENT_NOW}' AS ts FROM listed", OPP + "," + LIST_SQL))
def opp6(t: Tables):
    return opportunities.surfaced_events(listed(t), EVENT_NOW).select("viewer_id", "person_id", "kind", "ts")


@query("ag13_bucket_counts", with_sql(["viewer_events"], """
SELECT viewer_id, count_if(kind = 'detail_view') AS new, count_if(kind = 'interested') AS high_confidence, count_if(kind = 'not_interested') AS needs_validation, count_if(kind = 'contacted') AS revisit FROM viewer_events GROUP BY 1"""))
def ag13(t: Tables):
    k = F.col("kind")
    return agg.bucket_counts(t.viewer_events().withColumn("bucket", F.when(k == "detail_view", "new").when(k == "interested", "high-confidence")
                                                          .when(k == "not_interested", "needs-validation").when(k == "contacted", "revisit")))


# --- explanation ------------------------------------------------------------------------------
def explained_rows(t: Tables):
    """One candidate per condition row: the person of the same number, described by that person's data."""
    c = normalize_conditions(conditions(t)).withColumn("person_id", F.col("query_id"))
    p = t.persons().drop("created_at")
    rows = c.join(p.withColumnRenamed("status", "p_status"), "person_id")
    quote = explain.relevant_evidence(rows.select("query_id", "person_id", F.array(F.lit("ring"), F.lit("gear")).alias("skills")), t.evidence())
    return (rows.join(quote, ["query_id", "person_id"], "left")
            .withColumns({"skills": F.array(F.lower("headline"), F.lit("zzz")), "locations": F.array(F.element_at(F.split("location", " / "), 1), F.lit("Nowhere")),
                          "facet_role": F.array(F.lit("engineer")), "facet_tags": F.array().cast("array<string>"), "facet_location": F.array().cast("array<string>"),
                          "doc_text": F.lit("plain"), "evidence_text": F.lit(""), "sources": F.array(F.lit("GitHub")), "reference_date": F.col("updated_at"),
                          "experience_matched": F.col("confidence") > 0.5, "match_reasons": F.array(F.lit("skill evidence: ring"), F.lit("other")),
                          "score": F.col("confidence"), "has_role_evidence": F.lit(False)}))


AGE = f"CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000) AS BIGINT)"
REL = "CASE WHEN d <= 0 THEN '今天' WHEN d = 1 THEN '昨天' WHEN d <= 7 THEN d || '天前' WHEN d <= 30 THEN (d // 7) || '周前' WHEN d <= 365 THEN (d // 30) || '个月前' ELSE (d // 365) || '年前' END"
EXPLAIN = f"""x AS (SELECT cond.*, p.*, {AGE} AS d, quote FROM cond JOIN persons p ON p.person_id = cond.query_id LEFT JOIN (
    SELECT person_id, arg_min(CASE WHEN evidence_type = 'profile_field' THEN title || ': ' || description ELSE title END, (lvl, evidence_id)) AS quote FROM (
      SELECT *, CASE WHEN regexp_matches(title || ' ' || description, '(^| )(ring|gear)( |$)') THEN 0 WHEN evidence_type IN ('project', 'repository', 'experience') THEN 1 END AS lvl FROM evidence) WHERE lvl IS NOT NULL GROUP BY 1) USING (person_id)),
r AS (SELECT *, ['地点命中：' || split_part(location, ' / ', 1)] || CASE WHEN role = 'engineer' THEN ['角色贴合：engineer'] ELSE [] END || ['技术命中：' || lower(headline)]
  || CASE WHEN experience IS NOT NULL AND confidence > 0.5 THEN ['经验层级贴合：5年'] ELSE [] END || CASE WHEN source_bias = 'github' THEN ['来源过滤命中：GitHub'] ELSE [] END
  || CASE WHEN prefer_fresh THEN ['近期活跃：' || {REL}] ELSE [] END || ['检索技能命中：ring'] || CASE WHEN quote IS NOT NULL THEN ['相关证据：' || quote] ELSE [] END AS reasons FROM x)"""


@query("exp1_explanation", with_sql(["places", "persons", "evidence"], "SELECT query_id, reasons, array_to_string(reasons[1:2], '，') AS summary FROM r", COND_SQL + "," + EXPLAIN))
def exp1(t: Tables):
    return explain.explain(explained_rows(t), NOW).select("query_id", "reasons", F.col("summary_text").alias("summary"))


@query("exp2_condition_audit", with_sql(["places", "persons", "evidence"], """
SELECT query_id, u.label AS label, u.status AS status FROM (SELECT query_id, unnest([{'label': '地点', 'status': 'met'}, {'label': '角色', 'status': CASE WHEN role = 'engineer' THEN 'met' ELSE 'unmet' END},
  {'label': '技能 ' || lower(headline), 'status': 'met'}, {'label': '技能 zzz', 'status': 'unknown'}] || list_transform(must_have, lambda m: {'label': '必须项 ' || m, 'status': 'unknown'})
  || CASE WHEN experience IS NOT NULL THEN [{'label': '经验层级', 'status': CASE WHEN confidence > 0.5 THEN 'met' ELSE 'unknown' END}] ELSE [] END
  || CASE WHEN source_bias IS NOT NULL THEN [{'label': '来源过滤', 'status': 'met'}] ELSE [] END || CASE WHEN prefer_fresh THEN [{'label': '近期活跃', 'status': CASE WHEN d <= 90 THEN 'met' ELSE 'unmet' END}] ELSE [] END) AS u FROM r)""", COND_SQL + "," + EXPLAIN))
def exp2(t: Tables):
    return explain.audit_conditions(explained_rows(t), NOW).select("query_id", "label", "status")


@query("exp3_primary_links", with_sql(["identities", "profiles", "evidence"], """
SELECT person_id, label, url FROM (SELECT *, row_number() OVER (PARTITION BY person_id, url ORDER BY seq) AS rn FROM (
  SELECT person_id, CASE source WHEN 'bonjour' THEN 0 ELSE 1 END AS seq, CASE source WHEN 'bonjour' THEN 'Bonjour' ELSE 'GitHub' END AS label, min(url) AS url FROM identities JOIN profiles USING (profile_id) GROUP BY person_id, source
  UNION ALL SELECT person_id, 10 + rank, '作品页：' || title, url FROM (SELECT person_id, title, url, row_number() OVER (PARTITION BY person_id ORDER BY CASE evidence_type WHEN 'project' THEN 0 WHEN 'repository' THEN 1 ELSE 2 END, occurred_at DESC, evidence_id) AS rank
    FROM evidence WHERE url IS NOT NULL AND evidence_type IN ('project', 'repository', 'experience')) WHERE rank <= 2)) WHERE rn = 1"""))
def exp3(t: Tables):
    return explain.primary_links(t.identities(), t.profiles(), t.evidence()).select("person_id", "label", "url")


@query("exp3_source_badges", with_sql(["search_docs", "identities", "profiles"], """
SELECT person_id, list_sort(array_agg(DISTINCT CASE s WHEN 'bonjour' THEN 'Bonjour' WHEN 'github' THEN 'GitHub' ELSE s END)) AS sources FROM (
  SELECT person_id, unnest(facet_source) AS s FROM search_docs UNION ALL SELECT d.person_id, p.source FROM search_docs d JOIN identities i ON i.person_id = d.person_id JOIN profiles p ON p.profile_id = i.profile_id) GROUP BY 1"""))
def exp3_badges(t: Tables):
    return explain.source_badges(t.search_docs(), t.identities(), t.profiles())


@query("exp4_result_warnings", with_sql(["viewer_events"], """
SELECT c_custkey AS query_id, CASE WHEN top IS NULL THEN 'no_results' WHEN top = 2 THEN 'no_strong_match_medium' WHEN top = 1 THEN 'no_strong_match_weak' END AS warning
FROM customer LEFT JOIN (SELECT query_id, max(CASE strength WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS top FROM hits WHERE substr(md5(CAST(k AS VARCHAR)), 1, 1) < '8' GROUP BY 1) ON query_id = c_custkey""", HITS))
def exp4(t: Tables):
    queries = t.raw("customer").select(F.col("c_custkey").alias("query_id"))
    return explain.result_warnings(queries, attempt_hits(t).filter(half("k"))).select("query_id", "warning")


@query("exp5_result_cards", with_sql(["viewer_events", "persons", "evidence"], """
SELECT query_id, rank, person_id, name, CASE WHEN score >= 0.55 THEN 'strong' ELSE 'medium' END AS strength, coalesce(pv, []) AS preview FROM (
  SELECT query_id, k AS person_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM hits) JOIN persons USING (person_id)
LEFT JOIN (SELECT person_id, list(title ORDER BY rk) AS pv FROM (SELECT person_id, title, row_number() OVER (PARTITION BY person_id ORDER BY created_at DESC, evidence_id) AS rk FROM evidence) WHERE rk <= 3 GROUP BY 1) USING (person_id)
WHERE rank <= 10 AND persons.status <> 'hidden'""", HITS))
def exp5(t: Tables):
    # The operator takes scores above 1 for percents; a value above 500 is a ratio above 1, which counts as 1.
    from ..operators.common import top_k
    ranked = top_k(attempt_hits(t).withColumn("e", F.col("person_id")), ["query_id"], [F.desc("score"), "e"], 10).select(
        "query_id", "rank", F.col("k").alias("person_id"), F.least(F.col("score"), F.lit(1.0)).alias("final_score"), F.array(F.lit("skill evidence: x")).alias("match_reasons"))
    cards = explain.result_cards(ranked, t.persons(), t.evidence())
    return cards.select("query_id", "rank", "person_id", "name", "strength", F.coalesce(F.transform("preview", lambda x: x["title"]), F.array().cast("array<string>")).alias("preview"))


@query("exp6_query_word_reason", r"""
WITH x AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words, 'the and der que la of' AS ctx, 'the' AS loc FROM conversations),
f AS (SELECT *, list_filter(words, lambda w: contains(ctx, lower(w))) AS found FROM x)
SELECT conv_id, turn, CASE WHEN length(list_filter(found, lambda w: contains(loc, lower(w)))) > 0 THEN '地点命中：' || list_filter(found, lambda w: contains(loc, lower(w)))[1]
  WHEN length(found) > 0 THEN '命中查询词：' || array_to_string(found[1:2], ' / ') END AS reason FROM f""")
def exp6(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", explain.query_word_reason(F.col("text"), F.lit("the and der que la of"), F.lit("the")).alias("reason"))


# --- shortlist orders and dimension profiles ------------------------------------------------------
W8 = """strength AS (SELECT person_id, CAST(least(100, floor(s + least(12, ty * 3) + least(6, so * 2) + least(8, n) + 0.5)) AS INT) AS evidence FROM (
  SELECT person_id, sum(w * m + 2) AS s, count(DISTINCT evidence_type) AS ty, count(DISTINCT source) AS so FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY w DESC, occurred_at DESC, evidence_id) AS rk FROM (SELECT *, CASE evidence_type WHEN 'project' THEN 24 WHEN 'repository' THEN 22 WHEN 'experience' THEN 16 WHEN 'job_signal' THEN 14 ELSE 5 END AS w,
      CASE WHEN dd <= 30 THEN 1.0 WHEN dd <= 90 THEN 0.85 WHEN dd <= 365 THEN 0.65 ELSE 0.45 END::DOUBLE AS m FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '""" + NOW + """') - epoch_us(occurred_at)) / 86400000000) AS BIGINT) AS dd FROM evidence))) WHERE rk <= 8 GROUP BY 1)
  JOIN (SELECT person_id, count(*) AS n FROM evidence GROUP BY 1) USING (person_id))"""


def shortlist(t: Tables):
    c = t.persons().select(F.col("headline").alias("query_id"), "person_id", F.col("confidence").alias("match_score"), F.when(
        F.col("status") == "active", F.array(F.lit("Bonjour"), F.lit("GitHub"))).otherwise(F.array(F.lit("Unknown"))).alias("sources"),
        F.when(F.col("status") != "hidden", "u").alias("profile_url"), F.col("updated_at").alias("latest_evidence_at"), F.col("created_at").alias("last_synced_at"))
    return rank.shortlist_signals(c, rank.evidence_strength(t.evidence(), NOW), NOW)


@query("rnk6_shortlist_orders", with_sql(["persons", "evidence"], f"""
SELECT person_id, fresh, source, evidence, round(fresh * 0.75 + evidence * 0.15 + match * 0.1, 6) AS by_fresh, round(source * 0.7 + fresh * 0.15 + evidence * 0.1 + match * 0.05, 6) AS by_source,
  round(evidence * 0.72 + fresh * 0.16 + source * 0.07 + match * 0.05, 6) AS by_evidence FROM (
SELECT p.person_id, least(100, CASE WHEN d <= 7 THEN 100 WHEN d <= 30 THEN 86 WHEN d <= 90 THEN 68 WHEN d <= 180 THEN 46 WHEN d <= 365 THEN 24 ELSE 8 END + 6) AS fresh,
  CASE status WHEN 'active' THEN 90 WHEN 'hidden' THEN 10 ELSE 30 END AS source, coalesce(evidence, 0) AS evidence, confidence * 100 AS match FROM (SELECT *, {AGE} AS d FROM persons) p LEFT JOIN strength USING (person_id))""", W8))
def rnk6(t: Tables):
    return shortlist(t).select("person_id", "fresh", "source", "evidence", *[F.round(c, 6).alias(c) for c in ("by_fresh", "by_source", "by_evidence")])


DIMS = """dims AS (SELECT person_id, least(100, 40 + (coalesce(h1, FALSE)::INT + coalesce(h2, FALSE)::INT) / 2 * 60)::DOUBLE AS tech, CASE WHEN contains(lower(location), 'asia') THEN 100 ELSE 20 END AS location_match,
  CASE WHEN coalesce(nx, 0) = 0 THEN 70 ELSE 80 END AS stability, least(80, 40 + coalesce(nr, 0) * 5) AS project, least(100, least(100, 30 + coalesce(nr, 0) * 10) + 5) AS community,
  least(30, CASE WHEN coalesce(nc, 0) >= 3.5 THEN 10 ELSE 0 END + CASE WHEN headline = 'BUILDING' THEN 15 ELSE 0 END) AS bonus
  FROM persons LEFT JOIN (SELECT person_id, count_if(evidence_type = 'experience') AS nx, count_if(evidence_type = 'repository') AS nr, count_if(evidence_type IN ('experience', 'project')) AS nc,
    bool_or(contains(lower(title || ' ' || description), 'ring')) AS h1, bool_or(contains(lower(title || ' ' || description), 'promo')) AS h2 FROM evidence GROUP BY 1) USING (person_id)),
prof7 AS (SELECT *, round(least(100.0, tech * 0.30 + project * 0.25 + 40 * 0.15 + stability * 0.10 + community * 0.10 + location_match * 0.10 + bonus), 6) AS overall FROM dims)"""


def dimensions(t: Tables):
    return rank.dimension_profiles(t.persons(), t.evidence(), skills=["Ring", "promo"], locations=["Asia"], role="building", experience="5年")


@query("rnk7_dimension_profile", with_sql(["persons", "evidence"], "SELECT person_id, round(tech, 6) AS tech, location_match, stability, project, community, bonus AS experience_bonus, overall FROM prof7", DIMS))
def rnk7(t: Tables):
    return dimensions(t).select("person_id", F.round("tech", 6).alias("tech"), "location_match", "stability", "project", "community", F.col("experience_bonus").cast("int").alias("experience_bonus"),
                                F.round("overall", 6).alias("overall"))


@query("rnk8_custom_weights", with_sql(["persons", "evidence"], """
SELECT person_id, round(least(100.0, tech * 0.5 + project * 0.1 + 40 * 0.1 + stability * 0.1 + community * 0.1 + location_match * 0.1 + bonus), 6) AS overall FROM dims""", DIMS))
def rnk8(t: Tables):
    from ..config import DimensionWeights
    w = DimensionWeights(tech=0.5, project=0.1, academic=0.1, stability=0.1, community=0.1, location=0.1)
    p = rank.dimension_profiles(t.persons(), t.evidence(), skills=["Ring", "promo"], locations=["Asia"], role="building", experience="5年", weights=w)
    return p.select("person_id", F.round("overall", 6).alias("overall"))


# --- comparison -----------------------------------------------------------------------------------
def compared(t: Tables):
    """Comparison sets: persons of one location, described by their dimension profiles."""
    d = dimensions(t)
    c = t.persons().join(d.select("person_id", "overall", "tech", "project"), "person_id").select(
        F.col("location").alias("query_id"), "person_id", "overall", F.col("confidence").alias("match_score"), "tech", "project",
        F.when(F.col("status") == "active", F.array(F.lit("Bonjour"), F.lit("GitHub"))).when(F.col("status") == "claimed", F.array(F.lit("GitHub")))
        .otherwise(F.array(F.lit("Web"))).alias("sources"), F.when(F.col("headline") != "FURNITURE", F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.lit(3).alias("n_evidence"), F.when(F.col("headline") == "MACHINERY", 2).otherwise(0).alias("n_work_evidence"),
        F.col("updated_at").alias("latest_evidence_at"), F.col("created_at").alias("last_synced_at"))
    return compare.assess(c, NOW)


CMP = f"""ca AS (SELECT location AS query_id, person_id, round(overall * 0.7 + confidence * 100 * 0.2 + CASE WHEN d <= 7 THEN 8 WHEN d <= 30 THEN 5 WHEN d <= 90 THEN 2 ELSE 0 END + CASE WHEN tech >= 80 THEN 3 ELSE 0 END + CASE WHEN project >= 70 THEN 2 ELSE 0 END, 6) AS decision_score,
    confidence * 100 * 0.7 + overall * 0.3 AS gf, project * 0.6 + 30 + CASE WHEN headline = 'MACHINERY' THEN 16 ELSE 0 END AS es, tech AS te,
    CASE WHEN d <= 7 THEN 90 WHEN d <= 30 THEN 75 WHEN d <= 90 THEN 60 ELSE 42 END * 0.45 + CASE status WHEN 'active' THEN 88 WHEN 'claimed' THEN 72 ELSE 48 END * 0.55 AS sr, headline <> 'FURNITURE' AS has_reason
  FROM (SELECT *, {AGE} AS d FROM persons) JOIN prof7 USING (person_id)),
cb AS (SELECT *, CASE WHEN es >= 75 THEN 'strong' WHEN es >= 55 THEN 'mixed' ELSE 'weak' END AS esv, CASE WHEN sr >= 75 THEN 'strong' WHEN sr >= 55 THEN 'mixed' ELSE 'weak' END AS srv FROM ca),
cc AS (SELECT *, CASE WHEN esv = 'weak' THEN 'high' WHEN srv = 'weak' OR NOT has_reason THEN 'medium' ELSE 'low' END AS uncertainty FROM cb),
cd AS (SELECT *, row_number() OVER w AS rk, decision_score - lead(decision_score) OVER w AS lead FROM cc WINDOW w AS (PARTITION BY query_id ORDER BY decision_score DESC, person_id)),
co AS (SELECT query_id, person_id AS lead_id, CASE WHEN esv = 'weak' OR uncertainty = 'high' OR lead < 6 THEN 'no-recommendation' WHEN uncertainty = 'medium' OR lead < 12 OR srv = 'mixed' THEN 'conditional-recommendation' ELSE 'clear-recommendation' END AS mode FROM cd WHERE rk = 1)"""


@query("cmp1_decision_score", with_sql(["persons", "evidence"], "SELECT person_id, decision_score FROM ca", DIMS + "," + CMP))
def cmp1(t: Tables):
    return compared(t).select("person_id", F.round("decision_score", 6).alias("decision_score"))


@query("cmp2_assessment", with_sql(["persons", "evidence"], "SELECT person_id, esv AS evidence_strength_verdict, srv AS source_recency_verdict, uncertainty, CAST(greatest(0, least(100, floor(es + 0.5))) AS INT) AS evidence_strength FROM cc", DIMS + "," + CMP))
def cmp2(t: Tables):
    return compared(t).select("person_id", "evidence_strength_verdict", "source_recency_verdict", "uncertainty", "evidence_strength")


@query("cmp3_outcome", with_sql(["persons", "evidence"], "SELECT query_id, lead_id, mode FROM co", DIMS + "," + CMP))
def cmp3(t: Tables):
    return compare.outcomes(compared(t).withColumn("decision_score", F.round("decision_score", 6))).select("query_id", "lead_id", "mode")


RANKED_HITS = HITS + ", rh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM hits)"


def ranked_hits(t: Tables):
    return windows.shortlist_index(attempt_hits(t)).withColumnRenamed("shortlist_index", "rank")


@query("cmp4_compare_targets", with_sql(["viewer_events"], """
SELECT query_id, person_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot FROM (SELECT *, count_if(strength IN ('strong', 'medium')) OVER (PARTITION BY query_id) AS nr FROM rh) WHERE nr < 2 OR strength IN ('strong', 'medium')) WHERE slot <= 3""", RANKED_HITS))
def cmp4(t: Tables):
    return compare.comparison_targets(ranked_hits(t)).select("query_id", "person_id", "slot")


@query("cmp4_post_search_action", with_sql(["viewer_events"], """
SELECT query_id, CASE WHEN count_if(strength IN ('strong', 'medium')) >= 2 THEN 'compare' ELSE 'narrow' END AS action FROM hits GROUP BY 1""", HITS))
def cmp4_action(t: Tables):
    return compare.post_search_actions(attempt_hits(t))


@query("cmp5_export_confidence", with_sql(["viewer_events"], """
SELECT query_id, person_id, CASE WHEN gap >= 8 AND length(tags) >= 2 AND k % 2 = 0 THEN '高信心' WHEN length(tags) >= 1 AND (gap >= 4 OR length(tags) >= 2 OR k % 2 = 0) THEN '中信心' ELSE '低信心' END AS confidence FROM (
  SELECT query_id, person_id, k, sources AS tags, rank, score * 100 - lead(score * 100) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM rh) WHERE rank = 1""", RANKED_HITS))
def cmp5(t: Tables):
    r = attempt_hits(t).select("query_id", "person_id", F.col("score").alias("match_score"), (F.col("score") * 100).alias("pct"), F.size("sources").alias("n_evidence"), F.size("sources").alias("n_sources"),
                               F.when(F.col("k") % 2 == 0, "3天前").otherwise("2个月前").alias("freshness"))
    return compare.export_confidences(r).select("query_id", "person_id", "confidence")


# --- diagnostics ------------------------------------------------------------------------------------
def attempts(t: Tables):
    c = F.col("c_custkey")
    none = F.array().cast("array<string>")
    return t.raw("customer").select(
        c.alias("query_id"), F.when(F.col("c_nationkey") % 2 == 0, "engineer").alias("role"), F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("x"))).otherwise(none).alias("skills"),
        none.alias("must_have"), none.alias("locations"), F.lit(None).cast("string").alias("experience"), F.when(F.col("c_acctbal") > 5000, "github").alias("source_bias"),
        F.when(F.col("c_acctbal") > 9500, "somebody").alias("anchor_name"), F.when(F.col("c_acctbal") > 9500, "not_found").alias("anchor_status"),
        F.when(F.col("c_acctbal") < 0, 2).otherwise(0).alias("clarify_used"), F.lit(2).alias("clarify_limit"), F.when(F.col("c_acctbal") < 500, 1).otherwise(0).alias("rewrite_used"),
        F.lit(1).alias("rewrite_limit"), F.when(F.col("c_acctbal") > 0, 7).otherwise(0).alias("unrestricted_count"))


def attempt_failed(t: Tables):
    empty = F.array().cast("array<string>")
    rows = attempt_hits(t).select("query_id", F.when(half("k"), F.array(F.lit("source_bias"))).otherwise(empty).alias("failed"))
    silent = t.raw("customer").join(rows.select(F.col("query_id").alias("c_custkey")).distinct(), "c_custkey", "left_anti")
    missing = silent.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("query_id"), F.array(F.lit("must_have")).alias("failed"))
    return rows.unionByName(missing)


def weak_hits(t: Tables):
    """Hits in which viewers of odd number only found weak candidates."""
    return attempt_hits(t).withColumn("strength", F.when(F.col("query_id") % 2 == 1, "weak").otherwise(F.col("strength")))


DIAG = HITS.replace("CASE kind WHEN 'contacted'", "CASE WHEN viewer_id % 2 = 1 THEN 'weak' ELSE CASE kind WHEN 'contacted'").replace("WHEN 'not_interested' THEN 'weak' END AS strength", "WHEN 'not_interested' THEN 'weak' END END AS strength") + ", " + AUDIT + """,
rep AS (SELECT c_custkey AS query_id, coalesce(n, 0) AS hits, coalesce(n, 0) = 0 AS zero, coalesce(n > 0 AND w = n, FALSE) AS weak, c_nationkey % 2 = 0 AS has_role, c_nationkey % 3 = 0 AS has_skill,
  CASE WHEN aud IS NULL THEN TRUE ELSE met < 1 OR met / aud < 1.0 / 3 END AS mismatch, c_acctbal > 9500 AS anchor_bad, c_acctbal < 0 AS budget, c_acctbal > 5000 AS bias, CASE WHEN c_acctbal > 0 THEN 7 ELSE 0 END AS unres,
  coalesce(thin, FALSE) AS thin, coalesce(drops, 0) AS drops, coalesce(dom, 'unknown') AS dom, gap, mx, mn, c_acctbal
  FROM customer LEFT JOIN (SELECT query_id AS q1, count(*) AS n, count_if(strength = 'weak') AS w, max(length(reasons)) <= 1 AS thin, max(score) AS mx, min(score) AS mn, max(score) - max(score) FILTER (rk2 = 2) AS gap
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rk2 FROM hits) GROUP BY 1) ON q1 = c_custkey
  LEFT JOIN (SELECT query_id AS q2, count(*) AS aud, count_if(status = 'met') AS met FROM audit GROUP BY 1) ON q2 = c_custkey
  LEFT JOIN (SELECT q3, count(*) AS drops, mode(f) AS dom FROM (SELECT query_id AS q3, 'source_bias' AS f FROM hits WHERE substr(md5(CAST(k AS VARCHAR)), 1, 1) < '8' UNION ALL SELECT c_custkey, 'must_have' FROM customer WHERE c_custkey NOT IN (SELECT viewer_id FROM viewer_events) AND c_acctbal > 3000) GROUP BY 1) ON q3 = c_custkey),
fail AS (SELECT *, list_filter([CASE WHEN anchor_bad THEN 'intent_anchor_missing' END, CASE WHEN NOT has_role AND (zero OR weak) THEN 'intent_missing_role_axis' END, CASE WHEN NOT has_skill AND (zero OR weak) THEN 'intent_missing_skill_axis' END,
  CASE WHEN zero THEN 'retrieval_zero_hits' END, CASE WHEN zero AND drops > 0 THEN 'filter_too_strict' END, CASE WHEN bias AND unres > 0 AND dom = 'source_bias' THEN 'source_bias_conflict' END,
  CASE WHEN weak AND hits >= 3 AND coalesce(gap, 0) <= 0.03 AND mx - mn <= 0.08 THEN 'query_too_broad' END, CASE WHEN zero AND unres < 5 THEN 'source_coverage_gap' END, CASE WHEN weak THEN 'retrieval_all_weak' END,
  CASE WHEN mismatch THEN 'condition_mismatch_dominant' END, CASE WHEN thin AND weak THEN 'evidence_too_sparse' END, CASE WHEN budget THEN 'recovery_budget_exhausted' END], lambda x: x IS NOT NULL) AS codes FROM rep),
prim AS (SELECT *, CASE WHEN contains(codes, 'intent_anchor_missing') THEN 'intent_anchor_missing' WHEN contains(codes, 'intent_missing_role_axis') THEN 'intent_missing_role_axis' WHEN contains(codes, 'intent_missing_skill_axis') THEN 'intent_missing_skill_axis'
  WHEN contains(codes, 'filter_too_strict') THEN 'filter_too_strict' WHEN contains(codes, 'condition_mismatch_dominant') THEN 'condition_mismatch_dominant' WHEN contains(codes, 'retrieval_zero_hits') THEN 'retrieval_zero_hits' WHEN contains(codes, 'retrieval_all_weak') THEN 'retrieval_all_weak' END AS primary_code FROM fail)"""


def reports(t: Tables):
    return diagnose.attempt_reports(attempts(t), weak_hits(t), attempt_audit(t), attempt_failed(t), bounded=False)


@query("dia1_attempt_report", with_sql(["viewer_events"], "SELECT query_id, hits, weak AS all_weak, mismatch, hits > 0 AND NOT weak AS usable, has_role::INT + has_skill::INT + bias::INT + CASE WHEN anchor_bad AND has_role THEN 1 WHEN anchor_bad THEN 2 ELSE 0 END AS signals FROM rep", DIAG))
def dia1(t: Tables):
    return reports(t).select("query_id", "hits", "all_weak", "mismatch", "usable", "signals")


@query("dia2_failure_report", with_sql(["viewer_events"], "SELECT query_id, codes, primary_code FROM prim", DIAG))
def dia2(t: Tables):
    return diagnose.failure_reports(reports(t)).select("query_id", "codes", "primary_code")


@query("dia3_recovery_action", with_sql(["viewer_events"], """
SELECT query_id, CASE WHEN budget THEN CASE WHEN hits > 0 THEN 'low_confidence_shortlist' ELSE 'stop' END WHEN primary_code LIKE 'intent%' THEN 'clarify'
  WHEN primary_code IS NOT NULL AND c_acctbal >= 500 THEN 'rewrite' WHEN hits > 0 THEN 'low_confidence_shortlist' ELSE 'stop' END AS action FROM prim""", DIAG))
def dia3(t: Tables):
    return diagnose.recovery_actions(diagnose.failure_reports(reports(t))).select("query_id", "action")


@query("dia4_corpus_gap", with_sql(["viewer_events"], """
SELECT query_id, hits < 3 AND unres < 5 AS suspected, CASE WHEN contains(codes, 'source_coverage_gap') THEN 'source_coverage_gap' WHEN contains(codes, 'query_too_broad') THEN 'query_too_broad' WHEN contains(codes, 'source_bias_conflict') THEN 'source_bias_conflict' END AS boundary FROM prim""", DIAG))
def dia4(t: Tables):
    r = reports(t)
    gaps = diagnose.corpus_gaps(r.withColumn("drop_known", F.lit(True)))
    return gaps.join(diagnose.boundary_codes(diagnose.failure_reports(r)), "query_id").select("query_id", "suspected", "boundary")


def rounds(t: Tables):
    """Search rounds of each customer: one per order status, the shortlist being part numbers of that status."""
    from ..operators.common import top_k
    l = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(4).alias("round"), (F.col("l_partkey") % 10).alias("p"))
    head = top_k(l.distinct(), ["query_id", "round"], ["p"], 5, "slot")
    return head.groupBy("query_id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "p"))), lambda x: x["p"].cast("string")).alias("shortlist")).withColumn(
        "compare_size", F.when(F.col("query_id") % 4 == 0, 2).otherwise(0))


ROUNDS = """rounds AS (SELECT query_id, round, list(CAST(p AS VARCHAR) ORDER BY p) AS shortlist FROM (SELECT *, row_number() OVER (PARTITION BY query_id, round ORDER BY p) AS slot FROM (
  SELECT DISTINCT o_custkey AS query_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END AS round, l_partkey % 10 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE slot <= 5 GROUP BY 1, 2),
rn AS (SELECT *, length(list_filter(shortlist[1:3], lambda x: NOT contains(coalesce(before, []), x))) AS new_top FROM (SELECT *, lag(shortlist[1:3]) OVER (PARTITION BY query_id ORDER BY round) AS before FROM rounds))"""


@query("dia5_stop_rule", with_sql([], """
SELECT query_id, round, new_top, CASE WHEN round < 3 THEN NULL WHEN query_id % 4 = 0 THEN 'enough_compare' WHEN length(shortlist) >= 4 AND new_top <= 1 THEN 'enough_shortlist' WHEN length(shortlist) >= 3 AND new_top = 0 THEN 'low_marginal_gain'
  WHEN round >= 4 OR length(shortlist) < 3 OR new_top >= 2 THEN 'needs_user_clarification' END AS reason FROM rn""", ROUNDS))
def dia5(t: Tables):
    return diagnose.stop_decisions(rounds(t)).select("query_id", "round", "new_top", "reason")


# --- memory -----------------------------------------------------------------------------------------
LIVE = f"(expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20 00:00:00')"
MEM_NOW = "2024-01-20 00:00:00"


@query("mem1_list_memories", with_sql(["memories"], f"""
SELECT user_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, memory_id) AS rank FROM memories WHERE kind = 'preference' AND source = 'inferred' AND scope_kind = 'global' AND scope_value IS NULL AND {LIVE}) WHERE rank <= 5"""))
def mem1(t: Tables):
    return memory.list_memories(t.memories(), MEM_NOW, kind="preference", source="inferred", scope_kind="global", limit=5).select("user_id", "memory_id", "rank")


@query("mem2_purge", with_sql(["memories"], f"SELECT memory_id FROM memories WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{MEM_NOW}'"))
def mem2(t: Tables):
    return memory.purge_expired(t.memories(), MEM_NOW).select("memory_id")


@query("mem3_hydration", with_sql(["memories"], f"""
SELECT user_id, count_if(kind = 'preference' AND source = 'explicit') AS explicit, count_if(kind = 'preference' AND source = 'inferred') AS inferred, count_if(kind = 'feedback') AS feedback, count_if(kind = 'hiring_context') AS hiring,
  coalesce(string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY updated_at DESC, memory_id) FILTER (WHERE kind = 'feedback'), '') AS feedback_ids FROM memories WHERE {LIVE} GROUP BY 1 HAVING count_if(kind IN ('feedback', 'hiring_context') OR kind = 'preference' AND source IN ('explicit', 'inferred')) > 0"""))
def mem3(t: Tables):
    return memory.hydrate(t.memories(), MEM_NOW).select("user_id", *memory.GROUPS, F.array_join("feedback_ids", ",").alias("feedback_ids"))


@query("mem4_inferred_preferences", with_sql(["feedback", "memories"], f"""
SELECT user_id, preference_key, n FROM (SELECT user_id, CASE reason_code WHEN 'experience_mismatch' THEN 'avoidInexperience' WHEN 'not_active' THEN 'avoidInactive' END AS preference_key, count(*) AS n FROM feedback
  WHERE sentiment = 'negative' AND created_at > TIMESTAMP '{EVENT_NOW}' - INTERVAL 30 DAY GROUP BY 1, 2 HAVING count(*) >= 3) WHERE preference_key IS NOT NULL AND (user_id, preference_key) NOT IN (
  SELECT (user_id, preference_key) FROM memories WHERE kind = 'preference' AND preference_key IS NOT NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{EVENT_NOW}'))"""))
def mem4(t: Tables):
    return memory.infer_preferences(t.feedback(), t.memories(), EVENT_NOW).select("user_id", "preference_key", "n")


@query("mem5_text_preferences", r"""
SELECT conv_id, turn, list_filter(['ing', 'tion', 'ent'], lambda w: contains(lower(text), w)) || CASE WHEN role = 'user' THEN ['rust'] ELSE [] END AS tech_stack, CASE WHEN role = 'user' THEN 'backend' END AS wanted_role,
  CASE WHEN role = 'user' THEN ['杭州'] ELSE [] END AS locations FROM conversations""")
def mem5(t: Tables):
    c = t.raw("conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("role") == "user", " 会 Rust 后端 杭州").otherwise("")).alias("text"))
    return memory.preferences_from_text(c, technologies=["ing", "tion", "ent"]).select("conv_id", "turn", "tech_stack", F.col("role").alias("wanted_role"), "locations")


@query("mem6_seed_conditions", with_sql(["memories"], """
SELECT user_id, list_sort(list_distinct(flatten(list(tech_stack)))) AS skills, coalesce(list_sort(list_distinct(flatten(list(locations) FILTER (locations IS NOT NULL)))), []) AS locations,
  arg_min(role, (-epoch_us(updated_at), memory_id)) FILTER (role IS NOT NULL) AS role FROM memories WHERE kind = 'preference' AND source = 'explicit' GROUP BY 1"""))
def mem6(t: Tables):
    return memory.seed_conditions(t.memories(), MEM_NOW)


def cache(t: Tables):
    m = t.memories()
    return m.select(F.col("user_id").alias("person_id"), F.concat(F.lit("q"), F.col("memory_id") % 5).alias("query_key"), F.col("kind").alias("payload"), F.col("updated_at").alias("cached_at"),
                    (F.col("updated_at") + F.expr("interval 7 days")).alias("expires_at"), "memory_id").groupBy("person_id", "query_key").agg(
        F.max_by(F.struct("payload", "cached_at", "expires_at"), F.struct("cached_at", "memory_id")).alias("x")).select("person_id", "query_key", "x.*")


@query("mem7_result_cache", with_sql(["memories"], f"""
SELECT person_id, query_key, payload, expires_at FROM (SELECT user_id AS person_id, 'q' || (memory_id % 5) AS query_key, arg_max(kind, (updated_at, memory_id)) AS payload, max(updated_at) + INTERVAL 7 DAY AS expires_at FROM memories GROUP BY 1, 2)
WHERE expires_at > TIMESTAMP '{MEM_NOW}' AND query_key <> 'q1' UNION ALL SELECT user_id, 'q1', 'fresh', TIMESTAMP '{MEM_NOW}' + INTERVAL 7 DAY FROM (SELECT DISTINCT user_id FROM memories)"""))
def mem7(t: Tables):
    entries = t.memories().select(F.col("user_id").alias("person_id"), F.lit("q1").alias("query_key"), F.lit("fresh").alias("payload"))
    return memory.cache_store(cache(t), entries, MEM_NOW).select("person_id", "query_key", "payload", "expires_at")


@query("mem8_feedback_history", with_sql(["feedback"], """
SELECT user_id, feedback_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, feedback_id) AS rank FROM feedback WHERE sentiment = 'negative' AND created_at > TIMESTAMP '2024-01-10 00:00:00') WHERE rank <= 10"""))
def mem8(t: Tables):
    return memory.feedback_history(t.feedback(), "negative", "2024-01-10 00:00:00", 10).select("user_id", "feedback_id", "rank")


def forget_requests(t: Tables):
    c = t.raw("customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 2 == 0, "global").otherwise("role").alias("scope_kind"),
                    F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("role"), F.col("c_nationkey") % 5)).alias("scope_value"))


@query("mem9_forget_by_scope", with_sql(["memories"], """
SELECT memory_id FROM memories m JOIN customer ON c_custkey = user_id WHERE c_acctbal >= 1000 AND NOT (scope_kind = CASE WHEN c_nationkey % 2 = 0 THEN 'global' ELSE 'role' END
  AND scope_value IS NOT DISTINCT FROM CASE WHEN c_nationkey % 2 = 1 THEN 'role' || (c_nationkey % 5) END)"""))
def mem9(t: Tables):
    prefs = t.raw("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 1000).alias("memory_paused"))
    known = t.memories().join(prefs.select("user_id"), "user_id", "left_semi")
    kept, _ = memory.forget(known, forget_requests(t), prefs)
    return kept.select("memory_id")


# --- claims, opt-out, work items ---------------------------------------------------------------------
@query("clm1_claim_states", with_sql(["claims"], """
SELECT person_id, arg_min(claim_id, (verified_at, claim_id)) AS claim_id, count(*) AS n_approved, count(*) > 1 AS violation FROM claims WHERE status = 'approved' GROUP BY 1"""))
def clm1(t: Tables):
    return memory.claim_states(t.claims()).select("person_id", "claim_id", "n_approved", "violation")


@query("clm1_claim_requests", with_sql(["claims", "persons"], """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS request_id, CASE WHEN l_linenumber = 7 THEN 'invalid_method' WHEN l_partkey NOT IN (SELECT person_id FROM persons) THEN 'unknown_person'
  WHEN l_partkey IN (SELECT person_id FROM claims WHERE status = 'approved') THEN 'already_claimed'
  WHEN row_number() OVER (PARTITION BY l_partkey, l_linenumber = 7 ORDER BY lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || l_suppkey || '-' || CAST(l_quantity AS INT)) = 1 THEN 'accepted' ELSE 'already_claimed' END AS decision FROM lineitem"""))
def clm1_requests(t: Tables):
    l = t.raw("lineitem")
    r = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("request_id"), F.col("l_partkey").alias("person_id"),
                 F.when(F.col("l_linenumber") == 7, "fax").otherwise("email").alias("method"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_suppkey",
                                                                                                          F.col("l_quantity").cast("int")).alias("seq"))
    return memory.accept_claims(t.claims(), r, t.persons()).select("request_id", "decision")


@query("clm2_owner_changes", with_sql(["claims", "evidence"], """
SELECT evidence_id AS change_id, CASE WHEN (person_id + followers::INT % 2) NOT IN (SELECT person_id FROM claims WHERE status = 'approved') THEN 'not_claimed' WHEN followers::INT % 2 = 1 THEN 'not_owner' ELSE 'applied' END AS outcome FROM evidence"""))
def clm2(t: Tables):
    e = t.evidence()
    c = e.select(F.col("evidence_id").alias("change_id"), (F.col("person_id") + F.col("followers").cast("int") % 2).alias("person_id"), F.lit("delete_evidence").alias("action"),
                 "evidence_id", F.lit(None).cast("string").alias("evidence_type"))
    return memory.apply_owner_changes(c, t.claims(), e).select("change_id", "outcome")


@query("opt1_opt_out", with_sql(["profiles", "opt_outs"], """
SELECT profile_id, is_deleted OR (source, handle) IN (SELECT (source, handle) FROM opt_outs) AS is_deleted FROM profiles"""))
def opt1(t: Tables):
    return memory.process_opt_outs(t.profiles(), t.opt_outs())[0].select("profile_id", "is_deleted")


@query("opt1_searchable_persons", with_sql(["persons", "identities", "profiles", "opt_outs"], """
SELECT person_id FROM persons WHERE person_id NOT IN (SELECT person_id FROM identities) OR person_id IN (SELECT person_id FROM identities JOIN profiles p USING (profile_id) WHERE NOT is_deleted
  AND NOT EXISTS (SELECT 1 FROM opt_outs o WHERE o.source = p.source AND o.handle = p.handle AND o.status = 'processed'))"""))
def opt1_persons(t: Tables):
    return memory.searchable_persons(t.persons(), t.identities(), t.profiles(), t.opt_outs()).select("person_id")


@query("wrk1_work_items", """
SELECT user_id, item_id, rank FROM (SELECT o_custkey AS user_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O') WHERE rank <= 3""")
def wrk1(t: Tables):
    o = t.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return memory.work_items(o, "O", 3).select("user_id", "item_id", "rank")


@query("wrk1_recent_sessions", "SELECT conv_id AS session_id, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 10")
def wrk1_sessions(t: Tables):
    s = t.raw("conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count(F.lit(1)).alias("turns")).withColumn("updated_at", F.col("turns"))
    return memory.recent_sessions(s).select("session_id", "turns")


# --- evaluation ----------------------------------------------------------------------------------------
GOLD = RANKED_HITS + """, top AS (SELECT query_id, k AS person_id, rank, sources FROM rh WHERE rank <= 30), gold AS (SELECT DISTINCT query_id, k AS person_id FROM hits WHERE kind = 'contacted'),
ev AS (SELECT c_custkey AS query_id, coalesce(p5, 0) AS p5, coalesce(p10, 0) AS p10, coalesce(p20, 0) AS p20, coalesce(covered, FALSE) AS covered, coalesce(position, -1) AS position FROM customer LEFT JOIN (
  SELECT query_id, count_if(hit AND rank <= 5) / 5 AS p5, count_if(hit AND rank <= 10) / 10 AS p10, count_if(hit AND rank <= 20) / 20 AS p20, bool_or(hit) AS covered, min(rank) FILTER (hit) AS position
  FROM (SELECT *, (query_id, person_id) IN (SELECT (query_id, person_id) FROM gold) AS hit FROM top) GROUP BY 1) ON query_id = c_custkey)"""


def judged_run(t: Tables):
    h = attempt_hits(t)
    top = ranked_hits(t).filter("rank <= 30").select("query_id", F.col("k").alias("person_id"), "rank", "sources")
    gold = h.filter("kind = 'contacted'").select("query_id", F.col("k").alias("person_id"))
    return t.raw("customer").select(F.col("c_custkey").alias("query_id")), top, gold


@query("eva1_precision", with_sql(["viewer_events"], "SELECT query_id, p5, p10, p20 FROM ev", GOLD))
def eva1(t: Tables):
    return evaluate.evaluate(*judged_run(t)).select("query_id", "p5", "p10", "p20")


@query("eva2_coverage_position", with_sql(["viewer_events"], "SELECT query_id, covered, position FROM ev", GOLD))
def eva2(t: Tables):
    return evaluate.evaluate(*judged_run(t)).select("query_id", "covered", "position")


@query("ag21_eval_summary", with_sql(["viewer_events"], "SELECT count(*) AS queries, round(avg(p5), 9) AS avg_p5, round(avg(p10), 9) AS avg_p10, round(avg(p20), 9) AS avg_p20, round(avg(covered::INT), 9) AS coverage FROM ev", GOLD))
def ag21(t: Tables):
    s = evaluate.summarize(evaluate.evaluate(*judged_run(t)))
    return s.select("queries", *[F.round(c, 9).alias(c) for c in ("avg_p5", "avg_p10", "avg_p20", "coverage")])


@query("eva3_retrieval_benchmark", with_sql(["queries", "search_docs"], """
SELECT count(*) AS queries, round(avg(coalesce(p5, 0)), 9) AS avg_p5, round(avg(coalesce(p10, 0)), 9) AS avg_p10, round(avg(coalesce(p20, 0)), 9) AS avg_p20, round(avg(coalesce(covered, FALSE)::INT), 9) AS coverage FROM heads LEFT JOIN (
  SELECT query_id AS qid, count_if(hit AND rank <= 5) / 5 AS p5, count_if(hit AND rank <= 10) / 10 AS p10, count_if(hit AND rank <= 20) / 20 AS p20, bool_or(hit) AS covered
  FROM (SELECT k.query_id, k.rank, g.person_id IS NOT NULL AS hit FROM kw k LEFT JOIN found g ON g.query_id = k.query_id AND g.person_id = k.person_id) GROUP BY 1) ON qid = query_id""", RETRIEVE + r""",
heads AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS head FROM benchmark),
windows AS (SELECT doc_id, array_to_string(w[i + 1:i + 6], ' ') AS head FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 6, 0) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents))),
found AS (SELECT DISTINCT query_id, doc_id AS person_id FROM windows JOIN heads USING (head))"""))
def eva3(t: Tables):
    """Keyword hits of the benchmark passages judged against documents that hold the passage's first words."""
    from .search import keyword
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("head"))
    # Planted passages start at a sentence; every six-word window of a document is looked up by equality.
    words = F.split(F.col("text"), r"\s+")
    grams = t.raw("documents").select(F.col("doc_id").alias("person_id"), words.alias("w")).select("person_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - 6, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, 6), " ")))).alias("head"))
    gold = grams.join(q, "head").select("query_id", "person_id")
    e = evaluate.summarize(evaluate.evaluate(q, keyword(t).select("query_id", "person_id", "rank"), gold))
    return e.select("queries", *[F.round(c, 9).alias(c) for c in ("avg_p5", "avg_p10", "avg_p20", "coverage")])


@query("eva4_regression_checks", with_sql(["viewer_events"], """
SELECT c_custkey AS query_id, chk AS check, CASE chk WHEN 'min_results' THEN coalesce(n, 0) >= 20 WHEN 'min_code_in_top' THEN coalesce(c, 0) >= 2 ELSE coalesce(c, 0) >= least(5, coalesce(n, 0)) END AS passed FROM customer
CROSS JOIN (SELECT unnest(['min_results', 'min_code_in_top', 'all_top_include_code']) AS chk) LEFT JOIN (SELECT query_id, count(*) AS n, count_if(rank <= 5 AND contains(sources, 'robotics')) AS c FROM top GROUP BY 1) ON query_id = c_custkey""", GOLD))
def eva4(t: Tables):
    queries, top, _ = judged_run(t)
    kinds = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(n).alias("top_n"), F.lit(v).alias("value")) for c, n, v in (
        ("min_results", 5, 20), ("min_code_in_top", 5, 2), ("all_top_include_code", 5, 0))])
    checks = queries.select("query_id", F.explode(kinds).alias("x")).select("query_id", "x.*")
    return evaluate.regression_checks(checks, top, "robotics").select("query_id", "check", "passed")


@query("eva5_policy_acceptance", with_sql(["persons", "evidence"], """
SELECT query_id, 'search' AS clarify, CASE WHEN nr >= 2 THEN 'compare' ELSE 'narrow' END AS post, CASE WHEN nr >= 2 THEN mode END AS mode, nr >= 2 AND mode = 'no-recommendation' AS passed
FROM co JOIN (SELECT location AS query_id, count_if(status = 'active') AS nr FROM persons GROUP BY 1) USING (query_id)""", DIMS + "," + CMP))
def eva5(t: Tables):
    p = t.persons()
    fixtures = p.groupBy(F.col("location").alias("query_id")).agg(F.lit(0).alias("clarification_count")).withColumns({
        "skills": F.array(F.lit("x")), "role": F.lit(None).cast("string"), "experience": F.lit(None).cast("string"), "must_have": F.array().cast("array<string>"),
        "nice_to_have": F.array().cast("array<string>"), "expected_clarify": F.lit("search"), "expected_post": F.lit("compare"), "expected_mode": F.lit("no-recommendation")})
    candidates = p.select(F.col("location").alias("query_id"), "person_id", F.col("person_id").alias("rank"), F.when(F.col("status") == "active", "strong").otherwise("weak").alias("strength"))
    return evaluate.policy_acceptance(fixtures, candidates, compared(t).withColumn("decision_score", F.round("decision_score", 6)))

