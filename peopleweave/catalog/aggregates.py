"""Queries for aggregations."""
from pyspark.sql import functions as F

from ..bindings import EVENT_NOW, NOW, Tables, with_sql
from ..operators import aggregates as agg
from .filters import FAILED, failed
from .registry import query


@query("ag1_coverage", with_sql(["persons", "search_docs", "doc_embeddings", "identities", "profiles"], """
SELECT *, CAST(floor(indexed * 100 / active + 0.5) AS BIGINT) AS indexed_pct, CAST(floor(embedded * 100 / active + 0.5) AS BIGINT) AS embedded_pct,
  CAST(floor(multi_source * 100 / active + 0.5) AS BIGINT) AS multi_source_pct FROM (
SELECT (SELECT count(*) FROM persons) AS total, (SELECT count(*) FROM persons WHERE status = 'active') AS active,
  (SELECT count(DISTINCT person_id) FROM search_docs) AS indexed, (SELECT count(DISTINCT person_id) FROM doc_embeddings) AS embedded,
  (SELECT count(*) FROM (SELECT person_id FROM identities JOIN profiles USING (profile_id) GROUP BY 1 HAVING count(DISTINCT source) > 1)) AS multi_source,
  (SELECT count(DISTINCT person_id) FROM identities JOIN profiles USING (profile_id) WHERE source = 'bonjour') AS profile_covered,
  (SELECT count(DISTINCT person_id) FROM identities JOIN profiles USING (profile_id) WHERE source = 'github') AS code_covered)"""))
def ag1(t: Tables):
    return agg.coverage_report(t.persons(), t.search_docs(), t.embeddings(), t.identities(), t.profiles())


@query("ag1_coverage_sets", with_sql(["persons", "identities", "profiles"], """
SELECT source, status, count(DISTINCT person_id) AS persons, count(*) AS links FROM persons JOIN identities USING (person_id)
JOIN (SELECT profile_id, source FROM profiles) USING (profile_id) GROUP BY GROUPING SETS ((source, status), (source), (status), ())"""))
def ag1_sets(t: Tables):
    return agg.coverage_by_source_status(t.persons(), t.identities(), t.profiles())


@query("ag1_coverage_approx", with_sql(["persons", "search_docs", "doc_embeddings"], """
SELECT (SELECT count(*) FROM persons) AS total, (SELECT count(DISTINCT person_id) FROM search_docs) AS exact_indexed, (SELECT count(DISTINCT person_id) FROM doc_embeddings) AS exact_embedded,
  true AS indexed_close, true AS embedded_close"""))
def ag1_approx(t: Tables):
    # The sketch's standard error is 5 %; three of them must hold the exact count.
    near = agg.coverage_report(t.persons(), t.search_docs(), t.embeddings(), t.identities(), t.profiles(), approximate=True)
    exact = agg.coverage_report(t.persons(), t.search_docs(), t.embeddings(), t.identities(), t.profiles())
    exact = exact.select("total", F.col("indexed").alias("exact_indexed"), F.col("embedded").alias("exact_embedded"))
    close = [(F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.15 * F.col(f"exact_{c}")).alias(f"{c}_close") for c in ("indexed", "embedded")]
    return near.select("total", "indexed", "embedded").join(exact, "total").select("total", "exact_indexed", "exact_embedded", *close)


@query("ag2_evidence_count", with_sql(["evidence"], "SELECT person_id, count(*) AS evidence_count FROM evidence GROUP BY 1"))
def ag2(t: Tables):
    return agg.evidence_counts(t.evidence())


@query("ag3_rank_features", with_sql(["persons", "evidence"], f"""
SELECT p.person_id, coalesce(n, 0) AS evidence_count, coalesce(np, 0) AS project_count, coalesce(nr, 0) AS repo_count, 0 AS follower_count,
  CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000) AS INT) AS freshness
FROM persons p LEFT JOIN (SELECT person_id, count(*) AS n, count_if(evidence_type = 'project') AS np, count_if(evidence_type = 'repository') AS nr
  FROM evidence GROUP BY 1) e ON e.person_id = p.person_id"""))
def ag3(t: Tables):
    return agg.rank_features(t.persons(), t.evidence(), NOW)


SETS = """list_sort(array_agg(DISTINCT {0}) FILTER ({0} IS NOT NULL))"""


def mentions(t: Tables):
    r = t.post_refs()
    return r.withColumn("external_source", F.when(F.col("source_kind") == "external_import", F.concat(
        F.lit("batch"), F.length("handle"))))


MENTIONS = """mentions AS (SELECT *, CASE WHEN source_kind = 'external_import' THEN 'batch' || length(handle) END AS external_source FROM post_refs)"""
ACC = f"""SELECT handle, count_if(source_kind <> 'external_import') AS occurrences, coalesce({SETS.format('category')}, []) AS categories,
  coalesce({SETS.format('category_title')}, []) AS category_titles, coalesce({SETS.format('name')}, []) AS names, coalesce({SETS.format('description')}, []) AS descriptions,
  coalesce({SETS.format('source_kind')}, []) AS source_kinds, coalesce({SETS.format('external_source')}, []) AS external_sources FROM mentions"""


@query("ag5_handle_accumulator", with_sql(["post_refs"], ACC + " GROUP BY handle", MENTIONS))
def ag5(t: Tables):
    return agg.accumulate_handles(mentions(t))


@query("ag6_merge_summaries", with_sql(["post_refs"], f"""
SELECT a.handle, (SELECT max(n) FROM (SELECT count_if(source_kind <> 'external_import') AS n FROM mentions m WHERE m.handle = a.handle GROUP BY category)) AS occurrences,
  categories, category_titles, names, descriptions, source_kinds, external_sources FROM ({ACC} GROUP BY handle) a""", MENTIONS))
def ag6(t: Tables):
    m = mentions(t)
    rows = m.groupBy("handle", F.col("category").alias("batch")).agg(
        F.count_if(F.col("source_kind") != "external_import").alias("occurrences"),
        *[agg.sorted_set(c).alias(n) for c, n in (("category", "categories"), ("category_title", "category_titles"),
          ("name", "names"), ("description", "descriptions"), ("source_kind", "source_kinds"),
          ("external_source", "external_sources"))])
    return agg.merge_handle_summaries(rows)


@query("ag7_friend_preview", with_sql(["links"], """
SELECT dst AS handle, arg_min(name, seen_order) FILTER (name IS NOT NULL) AS name,
  arg_min(description, (-length(description), seen_order)) FILTER (description IS NOT NULL) AS description, count(*) AS sightings,
  list_sort(array_agg(DISTINCT edge_type)) AS edge_types, list_sort(array_agg(DISTINCT file)) AS files FROM links GROUP BY 1"""))
def ag7(t: Tables):
    return agg.friend_previews(t.links())


@query("ag8_frontier_summary", with_sql(["links"], """
SELECT dst AS handle, count(*) AS incoming, min(CASE WHEN edge_type = 'friend' THEN 1 ELSE 2 END) AS first_depth,
  list_sort(array_agg(DISTINCT src)) AS discovered_from FROM links GROUP BY 1"""))
def ag8(t: Tables):
    visits = t.links().withColumn("depth", F.when(F.col("edge_type") == "friend", 1).otherwise(2))
    return agg.frontier_summary(visits)


@query("ag9_negative_patterns", with_sql(["feedback"], f"""
SELECT user_id, reason_code, count(*) AS n, min(created_at) AS earliest_at, max(created_at) AS latest_at FROM feedback
WHERE sentiment = 'negative' AND reason_code IS NOT NULL AND created_at > TIMESTAMP '{EVENT_NOW}' - INTERVAL 30 DAY GROUP BY 1, 2 HAVING count(*) >= 3"""))
def ag9(t: Tables):
    return agg.negative_patterns(t.feedback(), EVENT_NOW)


@query("ag10_direction_counts", with_sql(["viewer_events"], """
SELECT viewer_id, tag, count(*) AS n FROM (SELECT DISTINCT viewer_id, kind IN ('interested', 'not_interested', 'contacted', 'revisit') AS grp, unnest(tags) AS tag FROM viewer_events) GROUP BY 1, 2"""))
def ag10(t: Tables):
    from ..operators import goals
    return goals.direction_counts(goals.event_signals(t.viewer_events()))


@query("ag11_viewer_snapshot", with_sql(["viewer_events"], """
SELECT viewer_id, count_if(kind = 'interested') AS interested, count_if(kind = 'not_interested') AS not_interested, count_if(kind = 'contacted') AS contacted,
  count_if(kind = 'revisit') AS revisit, count_if(kind = 'detail_view') AS detail_view, count_if(kind = 'repeat_view') AS repeat_view,
  count_if(kind = 'evidence_expand') AS evidence_expand, count_if(kind = 'dwell') AS dwell, count(DISTINCT person_id) AS candidates FROM viewer_events GROUP BY 1"""))
def ag11(t: Tables):
    return agg.viewer_snapshot(t.viewer_events())


STATE = """state AS (SELECT viewer_id, person_id, count_if(kind = 'surfaced') AS seen_count, count_if(kind = 'detail_view') AS detail_count,
    greatest(count_if(kind = 'detail_view') - 1, 0) + count_if(kind = 'repeat_view') + greatest(count_if(kind = 'surfaced') - 1, 0) AS repeat_count,
    arg_max(kind, (ts, event_id)) FILTER (kind IN ('interested', 'not_interested', 'contacted', 'revisit')) AS last_feedback,
    max(ts) FILTER (kind = 'surfaced') AS last_surfaced_at, max(ts) FILTER (kind = 'contacted') AS contacted_at
  FROM all_viewer_events GROUP BY 1, 2)"""


@query("ag12_candidate_state", with_sql(["all_viewer_events"], "SELECT * FROM state", STATE))
def ag12(t: Tables):
    return agg.candidate_state(t.all_viewer_events())


@query("ag14_follower_sum", with_sql(["evidence"], """
SELECT person_id, sum(followers) AS followers, round(0.02 * log10(sum(followers) + 1), 9) AS signal FROM evidence GROUP BY 1"""))
def ag14(t: Tables):
    return agg.follower_signal(t.evidence(), ("followers",), 0.02).withColumn("signal", F.round("signal", 9))


@query("ag15_latest_evidence", with_sql(["evidence"], """
SELECT person_id, max(occurred_at) AS latest_any, max(CASE WHEN source = 'github' THEN created_at ELSE occurred_at END) FILTER (evidence_type IN ('project', 'repository')) AS latest_work
FROM evidence GROUP BY 1"""))
def ag15(t: Tables):
    e = t.evidence()
    gap = e.withColumn("occurred_at", F.when(F.col("source") != "github", F.col("occurred_at"))).withColumn(
        "pushed_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    work = agg.latest_evidence(gap, work_only=True, fallback=("pushed_at",)).withColumnRenamed("latest_at", "latest_work")
    every = agg.latest_evidence(e).withColumnRenamed("latest_at", "latest_any")
    return every.join(work, "person_id", "left")


def attempt_hits(t: Tables):
    """Ranked hits of one search attempt per viewer, derived from the events."""
    v = F.col("value") / 500
    return t.viewer_events().select(
        F.col("viewer_id").alias("query_id"), F.col("event_id").alias("person_id"), v.alias("score"),
        F.when(F.col("kind") == "contacted", "strong").when(F.col("kind") == "interested", "medium")
        .when(F.col("kind") == "not_interested", "weak").alias("strength"), F.col("tags").alias("reasons"),
        F.col("tags").alias("sources"), F.col("kind"), F.col("person_id").alias("k"))


HITS = """hits AS (SELECT viewer_id AS query_id, event_id AS person_id, value / 500 AS score, CASE kind WHEN 'contacted' THEN 'strong' WHEN 'interested' THEN 'medium'
  WHEN 'not_interested' THEN 'weak' END AS strength, tags AS reasons, tags AS sources, kind, person_id AS k FROM viewer_events)"""


@query("ag16_score_distribution", with_sql(["viewer_events"], """
SELECT query_id, min(score) AS min, max(score) AS max, median(score) AS median, avg(score) FILTER (rk <= 3) AS top3_avg,
  coalesce(max(score) FILTER (rk = 1) - max(score) FILTER (rk = 2), 0.0) AS gap
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rk FROM hits) GROUP BY 1""", HITS))
def ag16(t: Tables):
    return agg.score_distribution(attempt_hits(t))


@query("ag17_strength_histogram", with_sql(["viewer_events"], """
SELECT query_id, count(*) AS total, count_if(strength = 'weak') AS weak, count_if(strength = 'medium') AS medium, count_if(strength = 'strong') AS strong,
  count_if(strength IS NULL) AS unknown, min(length(reasons)) AS reason_min, max(length(reasons)) AS reason_max, avg(length(reasons)) AS reason_avg,
  count_if(length(reasons) <= 1) AS thin, max(length(reasons)) <= 1 AS all_thin FROM hits GROUP BY 1""", HITS))
def ag17(t: Tables):
    return agg.strength_histogram(attempt_hits(t))


def attempt_audit(t: Tables):
    return attempt_hits(t).select("query_id", F.concat(F.lit("技能 s"), F.col("k") % 6).alias("label"),
                                  F.when(F.col("kind") == "contacted", "met").when(F.col("kind") == "detail_view", "unknown")
                                  .otherwise("unmet").alias("status"))


AUDIT = """audit AS (SELECT query_id, '技能 s' || (k % 6) AS label, CASE kind WHEN 'contacted' THEN 'met' WHEN 'detail_view' THEN 'unknown' ELSE 'unmet' END AS status FROM hits)"""


@query("ag18_audit_totals", with_sql(["viewer_events"], """
SELECT query_id, count(*) AS total, count_if(status = 'met') AS met, count_if(status = 'unmet') AS unmet, count_if(status = 'unknown') AS unknown,
  any_value(labels) AS unmet_labels
FROM audit LEFT JOIN (SELECT query_id, list(label ORDER BY rk) AS labels FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS rk
  FROM audit WHERE status = 'unmet' GROUP BY 1, 2) WHERE rk <= 3 GROUP BY 1) USING (query_id) GROUP BY 1""", HITS + ", " + AUDIT))
def ag18(t: Tables):
    return agg.audit_totals(attempt_audit(t))


@query("ag19_source_spread", with_sql(["viewer_events"], """
SELECT query_id, count_if(length(sources) = 1) AS single_source, count_if(length(sources) > 1) AS multi_source FROM hits GROUP BY 1""", HITS))
def ag19(t: Tables):
    return agg.source_spread(attempt_hits(t))


@query("ag20_filter_dropoff", with_sql(["search_docs"], """
SELECT query_id, count_if(f = 'must_have') AS must_have, count_if(f = 'exclude') AS exclude, count_if(f = 'source_bias') AS source_bias,
  coalesce((SELECT g FROM (SELECT g, count(*) AS c FROM (SELECT location AS q2, unnest(failed) AS g FROM failed JOIN search_docs USING (person_id)) WHERE q2 = query_id GROUP BY 1) ORDER BY c DESC, g DESC LIMIT 1), 'unknown') AS dominant
FROM (SELECT location AS query_id, unnest(CASE WHEN failed = [] THEN [NULL] ELSE failed END) AS f FROM failed JOIN search_docs USING (person_id)) GROUP BY 1""", FAILED))
def ag20(t: Tables):
    rows = failed(t).join(t.search_docs().select("person_id", F.col("location").alias("query_id")), "person_id")
    return agg.filter_dropoff(rows)


@query("ag22_merged_summary", with_sql(["identities", "profiles"], """
SELECT person_id, string_agg(part, chr(10) || chr(10) ORDER BY seq, part) AS summary FROM (
  SELECT person_id, '[' || source || '] ' || bio AS part, min(ordinal) AS seq FROM identities JOIN profiles USING (profile_id) GROUP BY 1, 2) GROUP BY 1"""))
def ag22(t: Tables):
    rows = t.identities().select("person_id", "profile_id").join(t.profiles(), "profile_id").select(
        "person_id", "source", F.col("ordinal").alias("seq"), F.concat("bio", F.lit("  ")).alias("text"))
    return agg.merged_summaries(rows)


@query("ag23_identity_confidence", with_sql(["identities"], """
SELECT person_id, CASE WHEN count(*) <= 1 THEN 0.5 ELSE coalesce(avg(match_score) FILTER (match_score > 0), 0.5) END AS confidence FROM identities GROUP BY 1"""))
def ag23(t: Tables):
    return agg.identity_confidence(t.identities())


@query("ag25_source_bundle", with_sql(["identities", "profiles"], """
SELECT person_id, count(*) AS n_sources, list_sort(array_agg(source || '|' || handle)) AS handles,
  coalesce(list_sort(array_agg(DISTINCT 'https://site.example/' || ordinal) FILTER (source = 'bonjour')), []) AS websites FROM identities JOIN profiles USING (profile_id) GROUP BY 1"""))
def ag25(t: Tables):
    sites = t.profiles().filter("source = 'bonjour'").select("profile_id", F.concat(
        F.lit("https://site.example/"), F.col("ordinal")).alias("website"))
    b = agg.source_bundles(t.identities(), t.profiles(), sites)
    return b.select("person_id", F.size("sources").alias("n_sources"), F.sort_array(F.transform(
        "sources", lambda s: F.concat_ws("|", s["source"], s["handle"]))).alias("handles"), "websites")


@query("ag26_completeness_diff", """
WITH l AS (SELECT c_custkey AS handle, c_name AS payload, c_acctbal > 0 AS has_name, c_nationkey > 5 AS has_info, c_nationkey AS n_items FROM customer),
r AS (SELECT o_custkey AS handle, CASE WHEN max(o_totalprice) > 400000 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'x' END AS payload, TRUE AS has_name, min(o_orderstatus) = 'F' AS has_info, count(*) AS n_items FROM orders GROUP BY 1)
SELECT count(*) AS handles, count(l.payload) AS left_ok, count(r.payload) AS right_ok, count_if(l.payload = r.payload) AS identical, count_if(l.payload <> r.payload) AS different,
  count_if(NOT coalesce(l.has_name, FALSE) AND coalesce(r.has_name, FALSE)) AS richer_name, count_if(NOT coalesce(l.has_info, FALSE) AND coalesce(r.has_info, FALSE)) AS richer_info,
  count_if(coalesce(r.n_items, 0) > coalesce(l.n_items, 0)) AS richer_items FROM l FULL JOIN r USING (handle)""")
def ag26(t: Tables):
    left = t.raw("customer").select(F.col("c_custkey").alias("handle"), F.col("c_name").alias("payload"),
                                    (F.col("c_acctbal") > 0).alias("has_name"), (F.col("c_nationkey") > 5).alias("has_info"),
                                    F.col("c_nationkey").alias("n_items"))
    right = t.raw("orders").groupBy(F.col("o_custkey").alias("handle")).agg(
        F.max("o_totalprice").alias("p"), (F.min("o_orderstatus") == "F").alias("has_info"), F.count(F.lit(1)).alias("n_items"))
    right = right.select("handle", F.when(F.col("p") > 400000, F.concat(F.lit("Customer#"), F.lpad(
        F.col("handle").cast("string"), 9, "0"))).otherwise("x").alias("payload"), F.lit(True).alias("has_name"),
        "has_info", "n_items")
    return agg.completeness_diff(left, right)
