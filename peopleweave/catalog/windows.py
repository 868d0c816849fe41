"""Queries for windows, sorts, top-k and set operations."""
from pyspark.sql import functions as F

from ..bindings import Tables, half, with_sql
from ..functions import arrays
from ..operators import windows as win
from .aggregates import HITS, attempt_hits
from .registry import query

WEIGHT = "CASE evidence_type WHEN 'project' THEN 24 WHEN 'repository' THEN 22 WHEN 'experience' THEN 16 WHEN 'job_signal' THEN 14 ELSE 5 END"
CMP = "CASE evidence_type WHEN 'project' THEN 0 WHEN 'repository' THEN 1 WHEN 'experience' THEN 2 WHEN 'job_signal' THEN 3 ELSE 4 END"


@query("wn1_first_wins", with_sql(["evidence"], """
SELECT person_id, title, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id, title ORDER BY occurred_at, evidence_id) AS rn FROM evidence) WHERE rn = 1"""))
def wn1(t: Tables):
    return win.first_wins(t.evidence().select("person_id", "title", "evidence_id", "occurred_at"),
                          ["person_id", "title"], ["occurred_at", "evidence_id"]).select("person_id", "title", "evidence_id")


@query("wn2_primary_fields", with_sql(["identities", "profiles"], """
SELECT person_id, arg_min(display_name, (source <> 'bonjour', ordinal)) AS name, arg_min(headline, (source <> 'bonjour', ordinal)) FILTER (headline IS NOT NULL) AS headline,
  arg_min(CASE WHEN source = 'github' THEN 'Earth / ' || location ELSE location END, (-(length(location) - length(replace(location, '/', '')) + CASE WHEN source = 'github' THEN 1 ELSE 0 END), ordinal)) AS location
FROM identities JOIN profiles USING (profile_id) GROUP BY 1"""))
def wn2(t: Tables):
    rows = t.identities().select("person_id", "profile_id").join(t.profiles(), "profile_id").withColumn(
        "seq", F.col("ordinal")).withColumn("location", F.when(F.col("source") == "github", F.concat(
            F.lit("Earth / "), F.col("location"))).otherwise(F.col("location")))
    return win.primary_fields(rows)


@query("wn3_component_winner", with_sql(["persons", "evidence"], """
SELECT location AS component, arg_min(person_id, (-(person_id % 3), -coalesce(n, 0), created_at, person_id)) AS winner, count(*) AS members
FROM persons LEFT JOIN (SELECT person_id, count(*) AS n FROM evidence GROUP BY 1) USING (person_id) GROUP BY 1"""))
def wn3(t: Tables):
    counts = t.evidence().groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    rows = t.persons().join(counts, "person_id", "left").select(
        F.col("location").alias("component"), "person_id", (F.col("person_id") % 3).alias("identities"),
        F.coalesce("n", F.lit(0)).alias("evidence"), "created_at")
    return win.component_winners(rows)


def _top(sql_order, n, where="TRUE"):
    return f"""SELECT person_id, evidence_id, rank FROM (SELECT person_id, evidence_id, row_number() OVER (PARTITION BY person_id ORDER BY {sql_order}) AS rank
  FROM evidence WHERE {where}) WHERE rank <= {n}"""


@query("wn4_preview_evidence", with_sql(["evidence"], _top("created_at DESC, evidence_id", 3)))
def wn4a(t: Tables):
    return win.preview_evidence(t.evidence()).select("person_id", "evidence_id", "rank")


@query("wn4_strongest_evidence", with_sql(["evidence"], _top(f"{WEIGHT} DESC, occurred_at DESC, evidence_id", 8)))
def wn4b(t: Tables):
    return win.strongest_evidence(t.evidence()).select("person_id", "evidence_id", "rank")


@query("wn4_comparison_evidence", with_sql(["evidence"], _top(f"{CMP}, occurred_at DESC, evidence_id", 3)))
def wn4c(t: Tables):
    return win.comparison_evidence(t.evidence()).select("person_id", "evidence_id", "rank")


@query("wn4_work_links", with_sql(["evidence"], _top(f"{CMP}, occurred_at DESC, evidence_id", 2, "url IS NOT NULL AND evidence_type IN ('project', 'repository', 'experience')")))
def wn4d(t: Tables):
    return win.work_links(t.evidence()).select("person_id", "evidence_id", "rank")


@query("wn5_comparison_rank", with_sql(["persons"], """
SELECT query_id, person_id, rank, score - lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS lead,
  CASE rank WHEN 1 THEN '优先深看' WHEN 2 THEN '继续比较' ELSE '补充候选' END AS decision_tag FROM (
SELECT location AS query_id, person_id, confidence AS score, row_number() OVER (PARTITION BY location ORDER BY confidence DESC, person_id) AS rank FROM persons)"""))
def wn5(t: Tables):
    rows = t.persons().select(F.col("location").alias("query_id"), "person_id", F.col("confidence").alias("decision_score"))
    return win.comparison_ranks(rows).select("query_id", "person_id", "rank", "lead", "decision_tag")


RANKED = """ranked AS (SELECT query_id, k AS person_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM hits)"""


@query("wn6_first_expected", with_sql(["viewer_events"], """
SELECT query_id, min(rank) AS position FROM ranked WHERE (query_id, person_id) IN (SELECT (query_id, k) FROM hits WHERE kind = 'contacted') GROUP BY 1""", HITS + ", " + RANKED))
def wn6(t: Tables):
    h = attempt_hits(t)
    ranked = win.shortlist_index(h).select("query_id", F.col("k").alias("person_id"), F.col("shortlist_index").alias("rank"))
    return win.first_expected(ranked, h.filter("kind = 'contacted'").select("query_id", F.col("k").alias("person_id")))


@query("wn7_shortlist_index", with_sql(["viewer_events"], """
SELECT query_id, person_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS shortlist_index FROM hits""", HITS))
def wn7(t: Tables):
    return win.shortlist_index(attempt_hits(t).select("query_id", "person_id", "score")).drop("score")


@query("wn8_same_name_groups", with_sql(["profiles"], """
SELECT query_id, profile_id, n AS group_size FROM (SELECT location AS query_id, profile_id, count(*) OVER (PARTITION BY location, substr(display_name, 1, 15)) AS n FROM profiles) WHERE n > 1"""))
def wn8(t: Tables):
    rows = t.profiles().select(F.col("location").alias("query_id"), "profile_id", F.substring("display_name", 1, 15).alias("name"))
    return win.same_name_groups(rows).select("query_id", "profile_id", "group_size")


COMPOSITE = """scored AS (SELECT location AS query_id, person_id, confidence * 75 + person_id % 7 AS composite, person_id % 3 AS fresh, person_id % 5 AS source, person_id % 4 AS evidence, confidence AS match,
  CASE WHEN status = 'active' THEN confidence * 100 END AS tech FROM persons)"""


def composite(t: Tables):
    p = F.col("person_id")
    return t.persons().select(
        F.col("location").alias("query_id"), "person_id", (F.col("confidence") * 75 + p % 7).alias("composite"),
        (p % 3).alias("fresh"), (p % 5).alias("source"), (p % 4).alias("evidence"), F.col("confidence").alias("match"),
        F.when(F.col("status") == "active", F.col("confidence") * 100).alias("tech"))


@query("tk4_rerank_orders", with_sql(["persons"], """
SELECT 'fresh' AS mode, query_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(composite, 3) DESC, fresh DESC, evidence DESC, source DESC, match DESC, person_id) AS rank FROM scored)
UNION ALL SELECT 'source', query_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(composite, 3) DESC, source DESC, fresh DESC, evidence DESC, match DESC, person_id) AS rank FROM scored)
UNION ALL SELECT 'evidence', query_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(composite, 3) DESC, evidence DESC, fresh DESC, source DESC, match DESC, person_id) AS rank FROM scored)""", COMPOSITE))
def tk4(t: Tables):
    rows = composite(t)
    parts = [win.rerank_order(rows, m).select(F.lit(m).alias("mode"), "query_id", "person_id", "rank")
             for m in ("fresh", "source", "evidence")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tk5_dimension_order", with_sql(["persons"], """
SELECT query_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(tech, -1) DESC, person_id) AS rank FROM scored)""", COMPOSITE))
def tk5(t: Tables):
    return win.dimension_order(composite(t), "tech").select("query_id", "person_id", "rank")


@query("tk6_paging", with_sql(["persons"], "SELECT person_id, confidence FROM persons ORDER BY confidence DESC, person_id LIMIT 50 OFFSET 30"))
def tk6(t: Tables):
    return win.page(t.persons().select("person_id", "confidence"), [F.desc("confidence"), "person_id"], limit=99.5, offset=30.7)


@query("tk7_seed_order", with_sql(["post_refs"], """
SELECT handle, occurrences FROM (SELECT handle, count_if(source_kind <> 'external_import') AS occurrences, count(name) > 0 AS named, count(DISTINCT source_kind) AS kinds FROM post_refs GROUP BY 1)
ORDER BY occurrences DESC, named DESC, kinds DESC, handle LIMIT 20 OFFSET 10"""))
def tk7(t: Tables):
    from ..operators import aggregates as agg
    from .aggregates import mentions
    rows = agg.accumulate_handles(mentions(t)).withColumn("name", F.get("names", F.lit(0)))
    return win.seed_order(rows, 20, 10).select("handle", "occurrences")


@query("tk8_candidate_pool", with_sql(["persons", "search_docs"], """
SELECT person_id FROM (SELECT p.person_id, d.updated_at, contains(facet_tags, 'der') AS tagged FROM persons p JOIN search_docs d USING (person_id) WHERE p.status <> 'hidden'
  ORDER BY d.updated_at DESC, p.person_id LIMIT 120) WHERE tagged ORDER BY updated_at DESC, person_id LIMIT 60"""))
def tk8(t: Tables):
    docs = t.search_docs().select("person_id", F.col("updated_at").alias("doc_updated_at"), F.transform(
        "facet_tags", lambda x: F.when(x == "der", F.lit("direction:der")).otherwise(x)).alias("facet_tags"))
    return win.candidate_pool(t.persons(), docs).select("person_id")


@query("so1_signal_union", with_sql(["search_docs"], """
SELECT person_id, list_sort(list_distinct(facet_tags || facet_role || facet_source)) AS signals FROM search_docs"""))
def so1(t: Tables):
    return t.search_docs().select("person_id", F.array_sort(arrays.unique_lower("facet_tags", "facet_role", "facet_source")).alias("signals"))


@query("so2_handle_difference", with_sql(["links", "profiles", "opt_outs"], """
SELECT DISTINCT dst AS handle FROM links WHERE dst NOT IN (SELECT handle FROM profiles WHERE substr(md5(handle), 1, 1) < '8')
  AND dst NOT IN (SELECT handle FROM opt_outs)"""))
def so2(t: Tables):
    handles = t.links().select(F.col("dst").alias("handle")).distinct()
    return win.subtract_handles(handles, t.profiles().filter(half("handle")), t.opt_outs())


@query("so3_direction_intersection", with_sql(["search_docs"], """
SELECT person_id, list_sort(list_intersect(facet_tags, ['the', 'les', 'x'])) AS shared FROM search_docs"""))
def so3(t: Tables):
    return t.search_docs().select("person_id", F.array_sort(F.array_intersect("facet_tags", F.array(
        F.lit("the"), F.lit("les"), F.lit("x")))).alias("shared"))


@query("so4_collapse_aliases", with_sql(["links"], """
SELECT handle, source_profile_id FROM (SELECT dst AS handle, CASE WHEN edge_type = 'friend' THEN 'id' || substr(dst, 5, 2) END AS source_profile_id,
  row_number() OVER (PARTITION BY CASE WHEN edge_type = 'friend' THEN 'profile:id' || substr(dst, 5, 2) ELSE 'handle:' || dst END ORDER BY seen_order) AS rn FROM links) WHERE rn = 1"""))
def so4(t: Tables):
    rows = t.links().select(F.col("dst").alias("handle"), F.when(F.col("edge_type") == "friend", F.concat(
        F.lit("id"), F.substring("dst", 5, 2))).alias("source_profile_id"), F.col("seen_order").alias("seq"))
    return win.collapse_aliases(rows).select("handle", "source_profile_id")
