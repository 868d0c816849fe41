"""Queries for sources, sinks and incremental writes."""
from pyspark.sql import functions as F

from ..bindings import NOW, Tables, half, with_sql
from ..operators import common
from ..session import shared_folder
from ..sources import readers, sinks
from .registry import query


@query("src1_scan_by_source", with_sql(["profiles"], """
SELECT profile_id, source, handle, synced_at FROM profiles WHERE source = 'bonjour'
ORDER BY synced_at DESC, profile_id LIMIT 100"""))
def src1(t: Tables):
    return readers.scan_by_source(t.profiles(), "bonjour", 100).select("profile_id", "source", "handle", "synced_at")


@query("src2_scan_by_handles", with_sql(["profiles", "links"], """
SELECT profile_id, handle, display_name FROM profiles WHERE source = 'bonjour' AND handle IN (SELECT dst FROM links)"""))
def src2(t: Tables):
    return readers.scan_by_handles(t.profiles(), "bonjour", t.links().select(F.col("dst").alias("handle"))).select(
        "profile_id", "handle", "display_name")


@query("src3_profile_files", """
SELECT 'cust/' || c_custkey AS handle, '{"name":"' || c_name || '"}' AS raw_payload FROM customer""")
def src3(t: Tables):
    files = t.raw("customer").select(F.concat(F.lit("cust%2F"), F.col("c_custkey"), F.lit(".json")).alias("file"),
                                     F.to_json(F.struct(F.col("c_name").alias("name"))).alias("text"))
    notes = files.select(F.regexp_replace("file", "json$", "txt").alias("file"), "text")
    return readers.parse_profile_files(files.unionByName(notes))


@query("src4_friend_links", with_sql(["links"], """
SELECT file, edge_type, dst, name, description FROM links"""))
def src4(t: Tables):
    entry = F.struct(F.concat(F.lit(" "), F.col("dst")).alias("profile_link"), "name", "description")
    none = F.lit(None).cast("array<struct<profile_link:string,name:string,description:string>>")
    files = t.links().select("file", F.to_json(F.struct(
        F.when(F.col("edge_type") == "friend", F.array(entry)).otherwise(none).alias("friend"),
        F.when(F.col("edge_type") == "friended", F.array(entry)).otherwise(none).alias("friended"))).alias("text"))
    return readers.parse_friend_files(files).select("file", "edge_type", "dst", "name", "description")


@query("src5_handle_lists", """
SELECT 'w' || c_custkey AS file, 'cust' || c_custkey AS handle, c_name AS name FROM customer
UNION ALL SELECT 'a' || s_suppkey, 'supp' || s_suppkey, NULL FROM supplier
UNION ALL SELECT 'a' || s_suppkey, 'alt' || s_suppkey, s_name FROM supplier
UNION ALL SELECT 't' || n_nationkey, 'n' || n_nationkey, NULL FROM nation
UNION ALL SELECT 't' || n_nationkey, 'm' || n_nationkey, NULL FROM nation""")
def src5(t: Tables):
    wrapped = t.raw("customer").select(F.concat(F.lit("w"), F.col("c_custkey")).alias("file"), F.format_string(
        '{"count": 1, "profiles": [{"profileLink": " cust%s ", "displayName": "%s"}]}', "c_custkey", "c_name").alias("text"))
    arrays = t.raw("supplier").select(F.concat(F.lit("a"), F.col("s_suppkey")).alias("file"), F.format_string(
        '["supp%s", {"slug": "alt%s", "name": "%s"}, {"other": 1}, ""]', "s_suppkey", "s_suppkey", "s_name").alias("text"))
    plain = t.raw("nation").select(F.concat(F.lit("t"), F.col("n_nationkey")).alias("file"), F.format_string(
        "# list\nn%s\n\n  m%s  \n", "n_nationkey", "n_nationkey").alias("text"))
    return readers.parse_handle_lists(wrapped.unionByName(arrays).unionByName(plain)).select("file", "handle", "name")


@query("src6_golden_records", """
SELECT CASE WHEN o_totalprice > 100000 THEN 'valid' ELSE 'rejected' END AS outcome, count(*) AS n_rows,
  count(DISTINCT o_custkey) AS n_persons FROM orders GROUP BY 1""")
def src6(t: Tables):
    lines = t.raw("orders").select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("queryId"), F.col("o_custkey").cast("string").alias("personId"),
        F.when(F.col("o_totalprice") > 100000, "high").otherwise("unsure").alias("relevance"))).alias("text"))
    ok, bad = readers.parse_records(lines, readers.GOLDEN_SCHEMA, ["queryId", "personId", "relevance"],
                                    {"relevance": ["high", "medium", "low"]})
    both = ok.select(F.lit("valid").alias("outcome"), F.col("personId").alias("p")).unionByName(
        bad.select(F.lit("rejected").alias("outcome"), F.get_json_object("text", "$.personId").alias("p")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("p").alias("n_persons"))


SEED_REFS = """refs AS (SELECT post_id, category, 6 - CAST(substr(category, 1, 1) AS INT) AS priority, post_id AS post_order,
  part * 1000000 + CAST(weight AS BIGINT) * 10000 + CAST(substr(handle, 5) AS BIGINT) AS ref_order, handle FROM post_refs)"""


@query("src7_seed_discovery", with_sql(["post_refs"], """
SELECT handle, via, origin FROM ranked WHERE rn = 1""", SEED_REFS + """,
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY post_order, ref_order) AS slot FROM refs)
  WHERE slot <= 3),
own AS (SELECT * FROM (SELECT handle, post_id, row_number() OVER (PARTITION BY handle ORDER BY post_order DESC, post_id) AS k
  FROM (SELECT DISTINCT handle, post_id, post_order FROM refs)) WHERE k <= 5),
cand AS (SELECT handle, 'category' AS via, category AS origin, -priority AS p, category AS c, 0 AS x, post_order AS o, ref_order AS r FROM refs
  UNION ALL SELECT refs.handle, 'profile_link', f.handle, -f.priority, f.category, 1, f.slot, refs.ref_order
  FROM first f JOIN own ON own.handle = f.handle JOIN refs ON refs.post_id = own.post_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY p, c, x, o, r, via, origin) AS rn FROM cand)"""))
def src7(t: Tables):
    refs = t.post_refs().select("post_id", "category", (6 - F.substring("category", 1, 1).cast("int")).alias("priority"),
                                F.col("post_id").alias("post_order"),
                                (F.col("part") * 1000000 + F.col("weight").cast("long") * 10000
                                 + F.substring("handle", 5, 20).cast("long")).alias("ref_order"), "handle")
    return readers.discover_seeds(refs)


@query("src8_person_evidence", with_sql(["persons", "evidence"], """
SELECT person_id, evidence_id, title, total, position FROM (
  SELECT e.person_id, evidence_id, title, count(*) OVER (PARTITION BY e.person_id) AS total,
    row_number() OVER (PARTITION BY e.person_id ORDER BY e.created_at DESC, evidence_id) AS position
  FROM evidence e WHERE e.person_id IN (SELECT person_id FROM persons WHERE status <> 'hidden'))
WHERE position > 5 AND position <= 15"""))
def src8_page(t: Tables):
    shown = t.persons().filter("status <> 'hidden'").select("person_id")
    return readers.evidence_page(t.evidence(), shown, limit=10, offset=5).select(
        "person_id", "evidence_id", "title", "total", "position")


@query("src8_evidence_by_type", with_sql(["evidence", "identities"], """
SELECT evidence_id, person_id, title, occurred_at FROM evidence WHERE evidence_type = 'repository'
  AND person_id IN (SELECT person_id FROM identities)"""))
def src8_type(t: Tables):
    return readers.rows_by_id(t.evidence().filter("evidence_type = 'repository'"), t.identities(), "person_id").select(
        "evidence_id", "person_id", "title", "occurred_at")


STORED = """stored AS (SELECT profile_id, source, handle, display_name, ordinal FROM profiles WHERE NOT is_deleted)"""


@query("snk1_upsert_profiles", with_sql(["profiles", "opt_outs"], """
SELECT profile_id, source, source_profile_id, handle, display_name, is_deleted FROM target
UNION ALL SELECT profile_id, source, source_profile_id, handle, display_name, FALSE FROM existing
WHERE profile_id NOT IN (SELECT profile_id FROM target)""", """existing AS (SELECT profile_id, source, source || ordinal AS source_profile_id, handle, display_name FROM profiles
  WHERE substr(md5(CAST(profile_id AS VARCHAR)), 1, 1) < '8'),
incoming AS (SELECT source, CASE WHEN source = 'github' THEN source || ordinal END AS source_profile_id,
    CASE WHEN source = 'github' THEN handle || '-renamed' ELSE handle END AS handle, display_name || ' new' AS display_name FROM profiles),
target AS (SELECT coalesce(a.profile_id, b.profile_id, sha256(i.source || '|' || coalesce(i.source_profile_id, i.handle))) AS profile_id,
    i.source, i.source_profile_id, i.handle, i.display_name,
    EXISTS (SELECT 1 FROM opt_outs o WHERE o.source = i.source AND o.handle = i.handle AND o.status = 'processed') AS is_deleted
  FROM incoming i LEFT JOIN existing a ON a.source = i.source AND a.source_profile_id = i.source_profile_id
  LEFT JOIN existing b ON b.source = i.source AND b.handle = i.handle)"""))
def snk1(t: Tables):
    p = t.profiles()
    pid = F.concat("source", "ordinal")
    existing = p.filter(half("profile_id")).select(
        "profile_id", "source", pid.alias("source_profile_id"), "handle", "display_name",
        F.lit(False).alias("is_deleted"), "synced_at", F.col("synced_at").alias("seen_at"))
    new = F.col("source") == "github"
    incoming = p.select("source", F.when(new, pid).alias("source_profile_id"),
                        F.when(new, F.concat("handle", F.lit("-renamed"))).otherwise(F.col("handle")).alias("handle"),
                        F.concat("display_name", F.lit(" new")).alias("display_name"), F.col("ordinal").alias("seq"))
    table = sinks.keyed_table(existing, shared_folder(t.spark, "profiles"), ["profile_id"], 16)
    sinks.merge_profiles(table, incoming, t.opt_outs(), NOW)
    return table.read().select("profile_id", "source", "source_profile_id", "handle", "display_name", "is_deleted")


@query("snk2_upsert_documents", with_sql(["search_docs", "doc_embeddings"], """
SELECT person_id, CASE WHEN e.person_id IS NOT NULL THEN 'new' ELSE 'old' END AS version,
  CASE WHEN e.person_id IS NOT NULL THEN e.embedded_at ELSE d.updated_at END AS updated_at
FROM search_docs d FULL JOIN doc_embeddings e USING (person_id)"""))
def snk2(t: Tables):
    existing = t.search_docs().select("person_id", F.lit("old").alias("version"), "updated_at")
    incoming = t.embeddings().select("person_id", F.lit("new").alias("version"), F.col("embedded_at").alias("updated_at"))
    earlier = incoming.select("person_id", F.lit("stale").alias("version"),
                              (F.col("updated_at") - F.expr("interval 1 day")).alias("updated_at"))
    table = sinks.keyed_table(existing, shared_folder(t.spark, "documents"), ["person_id"], 16)
    sinks.merge_by_person(table, incoming.unionByName(earlier), "updated_at")
    return table.read()


@query("snk3_insert_absent_evidence", with_sql(["evidence"], """
SELECT person_id, source, evidence_hash, evidence_id FROM (
  SELECT person_id, source, sha256(title || '|' || description) AS evidence_hash, evidence_id,
    row_number() OVER (PARTITION BY person_id, source, title, description ORDER BY created_at, evidence_id) AS rn
  FROM evidence WHERE evidence_type <> 'project') x
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.evidence_type = 'project' AND e.person_id = x.person_id
  AND e.source = x.source AND sha256(e.title || '|' || e.description) = x.evidence_hash)"""))
def snk3(t: Tables):
    e = t.evidence().withColumn("evidence_hash", F.sha2(F.concat_ws("|", "title", "description"), 256)).select(
        "person_id", "source", "evidence_hash", "evidence_id", "created_at", "evidence_type")
    old, new = e.filter("evidence_type = 'project'"), e.filter("evidence_type <> 'project'")
    table = sinks.keyed_table(old, shared_folder(t.spark, "evidence"), ["person_id"], 16)
    sinks.merge_absent(table, new, sinks.append_new_evidence)
    return table.read().filter("evidence_type <> 'project'").select("person_id", "source", "evidence_hash", "evidence_id")


@query("snk3_insert_absent_aliases", with_sql(["alias_rows"], """
SELECT person_id, alias_type, alias_value FROM alias_rows WHERE confidence < 1
EXCEPT SELECT person_id, alias_type, alias_value FROM alias_rows WHERE confidence = 1"""))
def snk3_aliases(t: Tables):
    a = t.alias_rows().withColumn("seq", F.col("person_id"))
    table = sinks.keyed_table(a.filter("confidence = 1"), shared_folder(t.spark, "aliases"), ["person_id"], 16)
    sinks.merge_absent(table, a.filter("confidence < 1"), sinks.append_new_aliases)
    return table.read().filter("confidence < 1").select("person_id", "alias_type", "alias_value")


@query("snk4_replace_identities", with_sql(["identities", "profiles"], """
SELECT p.profile_id, CASE WHEN p.ordinal IS NOT NULL AND p.source = 'github' THEN p.ordinal + 100000 ELSE i.person_id END AS person_id,
  CASE WHEN p.source = 'github' THEN 0.7 ELSE i.match_score END::DOUBLE AS match_score
FROM profiles p LEFT JOIN identities i ON i.profile_id = p.profile_id
WHERE p.source = 'github' OR i.profile_id IS NOT NULL"""))
def snk4(t: Tables):
    old = t.identities().select("profile_id", "person_id", "match_score")
    moved = t.profiles().filter("source = 'github'").select(
        "profile_id", (F.col("ordinal") + 100000).alias("person_id"), F.lit(0.7).alias("match_score"),
        F.col("ordinal").alias("seq"))
    table = sinks.keyed_table(old, shared_folder(t.spark, "identities"), ["profile_id"], 16)
    sinks.merge_identities(table, moved)
    return table.read()


@query("snk5_export_csv", with_sql(["persons"], """
SELECT CAST(person_id AS VARCHAR) || ',"' || name || ' ""' || headline || '""' || '",' || location || ',' || status AS line FROM persons"""))
def snk5(t: Tables):
    rows = t.persons().select(F.col("person_id"), F.concat("name", F.lit(' "'), "headline", F.lit('"')).alias("title"),
                              "location", "status")
    return sinks.csv_lines(rows)


@query("snk5_export_records", with_sql(["persons"], """
SELECT CAST(person_id AS VARCHAR) AS "shortlistIndex", name,
  CAST(CAST(floor(least(confidence * 100, 100) + 0.5) AS BIGINT) AS VARCHAR) || '%' AS "matchScore",
  CASE WHEN confidence * 100 >= 80 THEN '强' WHEN confidence * 100 >= 65 THEN '中' ELSE '弱' END || ' · ' || headline AS "goalFit",
  CASE WHEN status = 'active' THEN '强 · 2 条核心证据' WHEN status = 'claimed' THEN '中 · 1 条核心证据' ELSE '弱 · 0 条核心证据' END AS "evidenceStrength",
  CASE WHEN status = 'hidden' THEN '缺少可追溯的核心证据' WHEN status = 'claimed' THEN '主要依赖单一来源' ELSE '仍建议查看详情页确认上下文' END AS uncertainty,
  '低信心' AS confidence, '暂不推荐' AS "recommendationOutcome",
  CASE WHEN status = 'active' THEN '[GitHub/project] t1 (今天) | [Bonjour/role] t2' WHEN status = 'claimed' THEN '[GitHub/project] t1 (今天)' ELSE '' END AS "topEvidence"
FROM persons"""))
def snk5_records(t: Tables):
    item = lambda s, k, n, f: F.struct(F.lit(s).alias("source"), F.lit(k).alias("type"), F.lit(n).alias("title"),
                                       F.lit(f).cast("string").alias("freshness"))
    one, two = item("GitHub", "project", "t1", "今天"), item("Bonjour", "role", "t2", None)
    status = F.col("status")
    records = t.persons().select(
        F.col("person_id").alias("shortlistIndex"), "name", "headline", "location", F.lit(None).cast("string").alias("company"),
        F.col("confidence").alias("match_score"),
        F.when(status == "claimed", "GitHub").otherwise("GitHub, Bonjour").alias("source"), F.lit("今天").alias("freshness"),
        F.lit(None).cast("string").alias("bonjourUrl"), F.col("headline").alias("whyMatched"),
        *[F.lit(None).cast("string").alias(c) for c in ("decisionTag", "recommendation", "nextStep")],
        F.when(status == "active", F.array(one, two)).when(status == "claimed", F.array(one))
        .otherwise(F.array_except(F.array(one), F.array(one))).alias("top_evidence"))
    return sinks.export_records(records).select(
        "shortlistIndex", "name", "matchScore", "goalFit", "evidenceStrength", "uncertainty", "confidence",
        "recommendationOutcome", "topEvidence")


@query("snk6_signal_csv", with_sql(["post_refs"], """
SELECT handle || ',' || count(*) || ',' || count(DISTINCT category) AS line FROM post_refs GROUP BY handle"""))
def snk6(t: Tables):
    report = t.post_refs().groupBy("handle").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("category").alias("cats"))
    return sinks.csv_lines(report.orderBy(F.desc("cats"), F.desc("posts"), "handle"))


LEDGER = """SELECT o_custkey AS run_key, count(*) AS total, count_if(o_orderstatus <> 'F') AS processed, count_if(o_orderstatus = 'F') AS errors,
  min(o_orderdate) AS started_at FROM orders GROUP BY 1"""


def _ledger(t: Tables):
    work = t.raw("orders").select(
        F.concat(F.lit("run"), F.col("o_custkey")).alias("run_id"), F.lit("github").alias("source"),
        F.lit("code.sync").alias("job"), F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") != "F").alias("ok"),
        F.col("o_orderdate").alias("started_at"))
    return sinks.complete_runs(work, NOW)


@query("snk7_run_ledger", f"""
SELECT 'run' || run_key AS run_id, CASE WHEN errors = 0 THEN 'succeeded' WHEN processed > 0 THEN 'partial' ELSE 'failed' END AS status,
  processed, errors, CASE WHEN processed < total THEN processed END AS next_cursor, started_at FROM ({LEDGER})""")
def snk7(t: Tables):
    return _ledger(t).select("run_id", "status", "processed", "errors", "next_cursor", "started_at")


@query("snk8_latest_runs", f"""
SELECT 'run' || run_key AS run_id, started_at FROM ({LEDGER}) ORDER BY started_at DESC, run_id LIMIT 10""")
def snk8(t: Tables):
    return sinks.latest_runs(_ledger(t)).select("run_id", "started_at")


@query("snk10_snapshot_pending", """
SELECT item_id AS query_id, text FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def snk10(t: Tables):
    queries = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    manifest = t.raw("labels").select(F.col("doc_id").alias("query_id"),
                                      F.when(F.col("quality") == 1, "pass").otherwise("failed").alias("status"))
    return sinks.pending_queries(queries, manifest)
