"""Queries for joins."""
from pyspark.sql import functions as F

from ..bindings import Tables, with_sql
from ..operators import joins
from .registry import query


@query("jn1_document_person", with_sql(["search_docs", "persons"], """
SELECT d.person_id, d.facet_source, p.name, p.status FROM search_docs d JOIN persons p ON p.person_id = d.person_id"""))
def jn1(t: Tables):
    return joins.documents_with_persons(t.search_docs().select("person_id", "facet_source"),
                                        t.persons().select("person_id", "name", "status"))


@query("jn2_embedding_document_person", with_sql(["search_docs", "persons", "doc_embeddings"], """
SELECT person_id, label, location_doc, name FROM (SELECT person_id, label FROM doc_embeddings) JOIN (SELECT person_id, location AS location_doc FROM search_docs) USING (person_id)
JOIN (SELECT person_id, name FROM persons) USING (person_id)"""))
def jn2(t: Tables):
    return joins.embeddings_with_documents(
        t.embeddings().select("person_id", "label"), t.search_docs().select("person_id", F.col("location").alias("location_doc")),
        t.persons().select("person_id", "name"))


@query("jn3_unlinked_profiles", with_sql(["profiles", "identities"], """
SELECT profile_id, source, handle FROM profiles p WHERE NOT EXISTS (SELECT 1 FROM identities i WHERE i.profile_id = p.profile_id)"""))
def jn3(t: Tables):
    return joins.unlinked_profiles(t.profiles(), t.identities()).select("profile_id", "source", "handle")


@query("jn4_stale_documents", with_sql(["search_docs", "doc_embeddings"], """
SELECT d.person_id, e.person_id IS NULL AS missing FROM search_docs d LEFT JOIN doc_embeddings e ON e.person_id = d.person_id
WHERE e.person_id IS NULL OR e.embedded_at < d.updated_at"""))
def jn4(t: Tables):
    return joins.stale_documents(t.search_docs(), t.embeddings()).select(
        "person_id", F.col("embedded_at").isNull().alias("missing"))


@query("jn5_load_for_hits", with_sql(["evidence", "query_vectors"], """
SELECT evidence_id, person_id, title FROM evidence WHERE person_id IN (SELECT query_id FROM query_vectors)"""))
def jn5(t: Tables):
    hits = t.query_vectors().select(F.col("query_id").alias("person_id"))
    return joins.load_for_hits(t.evidence(), hits).select("evidence_id", "person_id", "title")


@query("jn6_source_hints", with_sql(["identities", "profiles"], """
SELECT person_id, source, handle, min(url) AS url FROM identities JOIN profiles USING (profile_id) GROUP BY 1, 2, 3"""))
def jn6(t: Tables):
    return joins.source_hints(t.identities(), t.profiles())


def leads(t: Tables):
    from ..operators import evidence
    return evidence.page_connections(t.raw("pages").withColumn("person_id", F.col("page_id")))


@query("jn7_new_leads", r"""
WITH a AS (SELECT page_id AS person_id, unnest(list_transform(regexp_extract_all(html, '(?i)<a[^>]*href="((?:https?:/)?/[^"#\s]+)', 1), lambda x: CASE WHEN x LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || x ELSE x END)) AS url FROM pages)
SELECT DISTINCT person_id, url FROM a WHERE url NOT IN (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/the' FROM pages)""")
def jn7(t: Tables):
    known = t.raw("pages").select(F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/the")).alias("url"))
    return joins.new_leads(leads(t), known).select("person_id", "url")


@query("jn8_multi_source", with_sql(["identities", "profiles"], """
SELECT person_id, count(DISTINCT source) AS n_sources FROM identities JOIN profiles USING (profile_id) GROUP BY 1 HAVING count(DISTINCT source) > 1"""))
def jn8(t: Tables):
    return joins.multi_source_persons(t.identities(), t.profiles())


@query("jn12_person_claim", with_sql(["persons", "claims"], """
SELECT p.person_id, p.status, CASE WHEN p.status = 'claimed' AND c.person_id IS NOT NULL THEN 'approved' END AS claim_status,
  CASE WHEN p.status = 'claimed' THEN c.at END AS verified_at
FROM persons p LEFT JOIN (SELECT person_id, max(verified_at) AS at FROM claims WHERE status = 'approved' GROUP BY 1) c USING (person_id)
WHERE p.status <> 'hidden'"""))
def jn12(t: Tables):
    return joins.with_claim(t.persons().filter("status <> 'hidden'"), t.claims()).select(
        "person_id", "status", "claim_status", "verified_at")


@query("jn13_claims_persons", with_sql(["persons", "claims"], """
SELECT claim_id, c.person_id, c.status, coalesce(p.name, 'Unknown') AS name FROM claims c
LEFT JOIN (SELECT * FROM persons WHERE status <> 'hidden') p ON p.person_id = c.person_id"""))
def jn13(t: Tables):
    return joins.claims_with_names(t.claims(), t.persons().filter("status <> 'hidden'")).select(
        "claim_id", "person_id", "status", "name")


@query("jn14_community_context", with_sql(["profiles", "post_refs"], """
SELECT profile_id, handle, n FROM profiles LEFT JOIN (SELECT handle, count(*) AS n FROM post_refs GROUP BY 1) USING (handle)"""))
def jn14(t: Tables):
    summaries = t.post_refs().groupBy("handle").agg(F.count(F.lit(1)).alias("n"))
    return joins.with_community_context(t.profiles().select("profile_id", "handle"), summaries)


@query("jn15_seed_handles", with_sql(["persons", "identities", "profiles"], """
SELECT person_id, confidence, handle FROM persons JOIN (SELECT person_id, arg_min(handle, profile_id) AS handle
  FROM identities JOIN profiles USING (profile_id) WHERE source = 'github' GROUP BY 1) USING (person_id) WHERE confidence > 0.5"""))
def jn15(t: Tables):
    return joins.seed_handles(t.persons(), t.identities(), t.profiles())


@query("jn16_opt_out_check", with_sql(["profiles", "opt_outs"], """
SELECT source, handle, EXISTS (SELECT 1 FROM opt_outs o WHERE o.source = p.source AND o.handle = p.handle AND o.status = 'processed') AS opted_out FROM profiles p"""))
def jn16(t: Tables):
    return joins.opted_out(t.profiles().select("source", "handle"), t.opt_outs())


@query("jn17_judged_results", with_sql(["viewer_events"], """
SELECT viewer_id AS query_id, person_id, event_id, (viewer_id, person_id) IN (SELECT (viewer_id, person_id) FROM viewer_events WHERE kind = 'interested') AS relevant
FROM viewer_events WHERE kind = 'detail_view'"""))
def jn17(t: Tables):
    e = t.viewer_events().withColumnRenamed("viewer_id", "query_id")
    return joins.judged(e.filter("kind = 'detail_view'").select("query_id", "person_id", "event_id"),
                        e.filter("kind = 'interested'"))


LOG = """log AS (SELECT vec_id AS log_id, e.ts, embedding, row_number() OVER (ORDER BY e.ts, vec_id) AS seq
  FROM embeddings JOIN events e ON event_id = vec_id)"""


def query_log(t: Tables):
    times = t.raw("events").select(F.col("event_id").alias("vec_id"), "ts")
    return t.raw("embeddings").join(times, "vec_id").select(F.col("vec_id").alias("log_id"), "ts", "embedding")


@query("jn18_query_reuse", with_sql([], """
SELECT log_id, hit_id, score FROM (SELECT a.log_id, b.log_id AS hit_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score,
    row_number() OVER (PARTITION BY a.log_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.seq) AS rn
  FROM log a JOIN log b ON a.seq - b.seq BETWEEN 1 AND 100 AND epoch_us(a.ts) - epoch_us(b.ts) <= 86400000000
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3) WHERE rn = 1""", LOG))
def jn18(t: Tables):
    from ..config import QueryCacheConfig
    cfg = QueryCacheConfig(threshold=0.3, ttl_seconds=86400)
    return joins.reusable_queries(query_log(t), cfg).withColumn("score", F.round("score", 6))
