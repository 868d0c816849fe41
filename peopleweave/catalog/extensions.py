"""Queries over the extension points and the remaining composites."""
from pyspark.sql import functions as F

from ..bindings import Tables, with_sql
from ..config import QueryCacheConfig
from ..functions import similarity, udfs
from ..operators import index, intent, joins, normalize, vocabulary
from .evidence_index import DIRECTIONS, FACETS, NEED, TAGS, hints, seeds
from .joins import LOG, query_log
from .normalisation import A_HANDLE, TRI
from .registry import query
from .search import SKILLS, _hits


@query("snk9_renormalise", with_sql(["places"], f"""
SELECT 'bonjour' AS source, {A_HANDLE} AS handle, r_name || ' / ' || n_name AS location FROM customer JOIN places ON c_nationkey = n_nationkey
UNION ALL SELECT 'github', 'supp' || s_suppkey, r_name || ' / ' || n_name FROM supplier JOIN places ON s_nationkey = n_nationkey"""))
def snk9(t: Tables):
    stored = t.raw_profiles().withColumn("stored_source", F.lit("bonjour")).unionByName(
        t.raw_code_profiles().withColumn("stored_source", F.lit("github")))
    return normalize.renormalize(stored).select("source", "handle", "location")


@query("qry5_reused_intent", with_sql([], """
SELECT log_id, hit_id, 'label ' || label AS intent FROM (SELECT a.log_id, b.log_id AS hit_id, row_number() OVER (PARTITION BY a.log_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.seq) AS rn
  FROM log a JOIN log b ON a.seq - b.seq BETWEEN 1 AND 50 AND epoch_us(a.ts) - epoch_us(b.ts) <= 43200000000
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35) JOIN embeddings ON vec_id = hit_id WHERE rn = 1""", LOG))
def qry5(t: Tables):
    hits = joins.reusable_queries(query_log(t), QueryCacheConfig(max_entries=50, threshold=0.35, ttl_seconds=43200))
    intents = t.raw("embeddings").select(F.col("vec_id").alias("hit_id"), F.concat(F.lit("label "), F.col("label")).alias("intent"))
    return hits.join(intents, "hit_id").select("log_id", "hit_id", "intent")


@query("idx4_tag_facets", with_sql(NEED, "SELECT person_id, facet_tags FROM tags", FACETS + ", " + TAGS))
def idx4(t: Tables):
    return index.tag_facets(t.persons(), t.evidence(), hints(t), seeds(t), DIRECTIONS)


@query("udf1_embedder", "SELECT doc_id AS person_id, 32 AS dimension, TRUE AS unit_length FROM documents")
def udf1(t: Tables):
    docs = t.raw("documents").select(F.col("doc_id").alias("person_id"), F.col("text").alias("doc_text"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    made = udfs.embed_documents(docs, lambda: udfs.hashed_embedder(32))
    length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return made.select("person_id", "dimension", (F.abs(length - 1) < 1e-4).alias("unit_length"))


@query("udf2_pair_scorer", """
SELECT item_id AS query_id, doc_id AS person_id, round(length(list_intersect(q, c)) / length(list_distinct(q)), 9) AS pair_score FROM (
  SELECT item_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> '')) AS q, list_distinct(regexp_split_to_array(lower(d.text), '\\s+')) AS c
  FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)""")
def udf2(t: Tables):
    items = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("intent_text"))
    docs = t.raw("documents").select(F.col("doc_id").alias("person_id"), F.col("text").alias("candidate_text"), (F.col("doc_id") % items.count()).alias("query_id"))
    pairs = items.join(docs, "query_id")
    return udfs.score_pairs(pairs).select("query_id", "person_id", F.round("pair_score", 9).alias("pair_score"))


@query("udf3_nfkc", "SELECT doc_id, text || 'A1' AS folded FROM documents")
def udf3(t: Tables):
    return t.raw("documents").select("doc_id", udfs.nfkc_udf()(F.concat("text", F.lit("Ａ１"))).alias("folded"))


@query("udf4_source_normaliser", "SELECT 'wiki' AS source, lower(c_name) AS handle FROM customer")
def udf4(t: Tables):
    def wiki(raw):
        return raw.select(F.lit("wiki").alias("source"), F.lower(F.get_json_object("raw_payload", "$.title")).alias("handle"))

    normalize.register_normaliser("wiki", wiki)
    try:
        raw = t.raw("customer").select(F.to_json(F.struct(F.col("c_name").alias("title"))).alias("raw_payload"))
        return normalize.NORMALISERS["wiki"](raw)
    finally:
        del normalize.NORMALISERS["wiki"]


@query("udf5_vocabulary_table", f"""
SELECT DISTINCT row_id, unnest({_hits(SKILLS)}) AS canonical FROM (SELECT doc_id AS row_id, lower(text) AS l FROM documents)""")
def udf5(t: Tables):
    rows = [(name, p) for name, patterns in SKILLS.items() for p in patterns]
    table = t.spark.createDataFrame(rows, "canonical string, pattern string")
    return vocabulary.table_hits(t.raw("documents").select(F.col("doc_id").alias("row_id"), "text"), table)


@query("udf5_vocabulary_intents", f"""
SELECT item_id AS query_id, {_hits(dict(sorted(SKILLS.items())))} AS skills FROM (SELECT item_id, lower(text) AS l FROM benchmark)""")
def udf5_intents(t: Tables):
    rows = [(name, p) for name, patterns in SKILLS.items() for p in patterns]
    table = t.spark.createDataFrame(rows, "canonical string, pattern string")
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    return intent.tag_intents(q, skills=vocabulary.vocabulary_dict(table)).select("query_id", "skills")


@query("udf7_trigram_table_function", f"""
SELECT p_partkey, length({TRI.format('p_name')}) AS n_udtf, length({TRI.format('p_name')}) AS n_native FROM part""")
def udf7(t: Tables):
    udfs.register_sql(t.spark)
    t.raw("part").select("p_partkey", "p_name").createOrReplaceTempView("udtf_parts")
    counts = t.spark.sql("SELECT p_partkey, count(*) AS n_udtf FROM udtf_parts, LATERAL text_trigrams(p_name) GROUP BY p_partkey")
    native = t.raw("part").select("p_partkey", F.size(similarity.trigrams("p_name")).alias("n_native"))
    return counts.join(native, "p_partkey")


@query("udf7_evidence_table_function", """
SELECT c_custkey AS row_id, 1 + CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 3000 THEN 1 ELSE 0 END + 1 + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS n FROM customer""")
def udf7_evidence(t: Tables):
    udfs.register_sql(t.spark)
    t.raw_profiles().createOrReplaceTempView("udtf_profiles")
    return t.spark.sql("SELECT row_id, count(*) AS n FROM udtf_profiles, LATERAL profile_evidence(raw_payload) GROUP BY row_id")
