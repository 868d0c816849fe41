"""Queries for the composed jobs: ingest, search and daily list from end to end."""
from pyspark.sql import functions as F

from ..bindings import EVENT_NOW, NOW, Tables, with_sql
from ..plans import daily, ingest, search as search_plan
from ..session import shared_folder
from ..sources.sinks import keyed_table
from .evidence_index import DIRECTIONS
from .normalisation import A_HANDLE
from .people import LIST_SQL, OPP, OPP_NEED, goal_texts
from .registry import query
from .search import RANK_NEED, RANK_SQL

PROFILES = ("profile_id string, source string, source_profile_id string, handle string, url string, display_name string, headline string, bio string, summary string, "
            "location string, profile_hash string, is_deleted boolean, synced_at timestamp, seen_at timestamp")


@query("plan_ingest_profiles", with_sql(["places", "opt_outs"], f"""
SELECT sha256(source || '|' || source_profile_id) AS profile_id, source, handle, location, (source, handle) IN (SELECT (source, handle) FROM opt_outs WHERE status = 'processed') AS is_deleted FROM landed""", f"""
landed AS (SELECT 'bonjour' AS source, 'a' || c_custkey AS source_profile_id, {A_HANDLE} AS handle, r_name || ' / ' || n_name AS location FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'github', CAST(s_suppkey AS VARCHAR), 'supp' || s_suppkey, r_name || ' / ' || n_name FROM supplier JOIN places ON s_nationkey = n_nationkey)"""))
def plan_ingest(t: Tables):
    table = keyed_table(t.spark.createDataFrame([], PROFILES), shared_folder(t.spark, "profiles"), ["profile_id"], 16)
    for source, raw in (("bonjour", t.raw_profiles()), ("github", t.raw_code_profiles()), ("bonjour", t.raw_profiles())):  # landed twice, stored once
        ingest.store_profiles_in(table, raw, source, t.opt_outs(), NOW)
    return table.read().select("profile_id", "source", "handle", "location", "is_deleted")


@query("plan_search", with_sql(RANK_NEED, """
SELECT query_id, person_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, person_id) AS rank, round(final_score, 6) AS final_score FROM final""", RANK_SQL))
def plan_search(t: Tables):
    docs = t.search_docs()
    out = search_plan.run_search(t.queries(), docs.select("person_id", "name", "headline", "status"), docs, t.embeddings(), t.evidence().drop("stars"), t.query_vectors(), intents=t.queries())
    return out["ranked"].select("query_id", "person_id", "rank", F.round("final_score", 6).alias("final_score"))


@query("plan_daily_list", with_sql(OPP_NEED, "SELECT viewer_id, rank, person_id, CASE WHEN rank <= 3 THEN 'top' ELSE 'more' END AS section FROM listed", OPP + "," + LIST_SQL))
def plan_daily(t: Tables):
    docs = t.search_docs().select("person_id", F.col("updated_at").alias("doc_updated_at"), "facet_tags", "facet_source", "freshness")
    out = daily.run_daily(t.persons(), docs, t.evidence(), t.viewer_events(), goal_texts(t), EVENT_NOW, directions=DIRECTIONS, history=t.all_viewer_events())
    return out["list"].select("viewer_id", "rank", "person_id", "section")
