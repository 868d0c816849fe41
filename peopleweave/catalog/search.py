"""Queries for query understanding, retrieval, ranking and explanation."""
from pyspark.sql import functions as F

from ..bindings import Tables, with_sql
from ..functions import udfs
from ..operators import intent, rank, retrieve
from ..session import cut_lineage
from .normalisation import COND_SQL, NORM_SQL, TRI, conditions
from .registry import query

ROLES = {"reader": ["the ", "der "], "writer": ["que", "les"], "guide": ["para"]}
SKILLS = {"and": ["and"], "ing": ["ing", "ung"], "tion": ["tion", "ción"]}
SCHOOLS = {"ouen school": ["ouen"]}
PLACES = ["thar", "und", "that", "pas"]
LEVELS = ["tin", "ent", "est"]


def asked(t: Tables):
    """Query table: benchmark passages and user turns."""
    a = t.raw("benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.col("text").alias("raw_query"))
    c = t.raw("conversations").filter("role = 'user'").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("query_id"),
                                                              F.concat("text", F.lit(' must have speed, prefer "quiet rooms".')).alias("raw_query"))
    return a.unionByName(c)


def _hits(families, col="l"):
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({col}, '{p}')" for p in ps) + f" THEN '{n}' END"
                                       for n, ps in families.items()) + "], lambda x: x IS NOT NULL)"


ASKED = f"""asked AS (SELECT *, lower(raw_query) AS l FROM (SELECT 'b' || item_id AS query_id, text AS raw_query FROM benchmark
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text || ' must have speed, prefer "quiet rooms".' FROM conversations WHERE role = 'user')),
tagged AS (SELECT query_id, raw_query, {_hits(ROLES)} AS roles, {_hits(SKILLS)} AS skills,
  CASE WHEN contains(l, 'ouen') THEN ['hangzhou'] ELSE [] END || list_filter(regexp_extract_all(l, '({'|'.join(PLACES)})', 1), lambda x: TRUE) AS loc_raw,
  CASE WHEN contains(l, 'tin') THEN 'tin' WHEN contains(l, 'ent') THEN 'ent' WHEN contains(l, 'est') THEN 'est' END AS experience_level,
  CASE WHEN query_id LIKE 'c%' THEN ['quiet rooms', 'speed'] ELSE [] END || CASE WHEN contains(l, 'ouen') THEN ['ouen school'] ELSE [] END AS must_haves,
  CASE WHEN query_id LIKE 'c%' THEN ['"quiet rooms"'] ELSE [] END AS nice_to_haves FROM asked)"""


def tagged(t: Tables):
    return intent.tag_intents(asked(t), ROLES, SKILLS, SCHOOLS, PLACES, LEVELS)


@query("qry1_intent_tagging", with_sql([], """
SELECT query_id, roles, skills, list_sort(list_distinct(loc_raw)) AS locations, experience_level, CAST(NULL AS VARCHAR) AS source_bias, must_haves, nice_to_haves FROM tagged""", ASKED))
def qry1(t: Tables):
    return tagged(t).select("query_id", "roles", "skills", F.array_sort("locations").alias("locations"), "experience_level", "source_bias",
                            "must_haves", "nice_to_haves")


@query("qry2_merge_external", with_sql([], """
SELECT query_id, list_sort(list_distinct(['cto'] || roles)) AS roles, list_sort(list_distinct(['kubernetes'] || skills)) AS skills, list_sort(list_distinct(loc_raw)) AS locations, coalesce('senior', experience_level) AS experience_level,
  'github' AS source_bias, list_sort(list_distinct(['golang'] || must_haves)) AS must_haves, list_sort(list_distinct(['github stars', 'recently active'] || nice_to_haves)) AS nice_to_haves FROM tagged""", ASKED))
def qry2(t: Tables):
    ext = asked(t).select("query_id", F.array(F.lit(" CTO ")).alias("ext_roles"), F.array(F.lit("Kubernetes ")).alias("ext_skills"),
                          F.lit(None).cast("array<string>").alias("ext_locations"), F.lit("Senior").alias("ext_experience_level"),
                          F.lit("GitHub").alias("ext_source_bias"), F.array(F.lit("Golang"), F.lit("GitHub stars"), F.lit("recently active")).alias("ext_must_haves"),
                          F.lit(None).cast("array<string>").alias("ext_nice_to_haves"))
    m = intent.merge_external(tagged(t), ext)
    lists = ("roles", "skills", "locations", "must_haves", "nice_to_haves")
    return m.select("query_id", "experience_level", "source_bias", *[F.array_sort(c).alias(c) for c in lists])


@query("qry3_merge_conditions", with_sql(["queries", "places"], """
SELECT q.query_id, list_sort(list_distinct(q.roles || [c.role])) AS roles, list_sort(list_distinct(q.skills || list_transform(c.skills, lambda x: lower(x)))) AS skills,
  list_sort(list_distinct(q.must_haves || [c.role] || list_transform(c.skills, lambda x: lower(x)) || list_transform(c.must_have, lambda x: lower(x)))) AS must_haves,
  coalesce(c.source_bias, q.source_bias) AS source_bias FROM queries q JOIN cond c USING (query_id)""", COND_SQL))
def qry3(t: Tables):
    from ..operators.normalize import normalize_conditions
    q = t.queries().withColumn("experience_level", F.lit(None).cast("string"))
    m = intent.merge_conditions(q, normalize_conditions(conditions(t)))
    return m.select("query_id", *[F.array_sort(c).alias(c) for c in ("roles", "skills", "must_haves")], "source_bias")


@query("qry4_keyword_query", with_sql(["queries"], f"""
SELECT query_id, array_to_string(list_transform(list_filter(p, lambda x, i: list_position(p, x) = i), lambda x: x), ' ') AS keyword_query FROM (
  SELECT query_id, list_filter(list_transform([raw_query] || roles || skills || must_haves, lambda x: {NORM_SQL.format('x')}), lambda x: x <> '') AS p FROM queries)"""))
def qry4(t: Tables):
    return t.queries().select("query_id", intent.keyword_query().alias("keyword_query"))


@query("qry6_anchor_resolution", with_sql(["profiles"], """
SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 8 BETWEEN 1 AND 5 THEN 'resolved' ELSE 'not_found' END
  ELSE CASE WHEN c = 1 THEN 'resolved' WHEN c > 1 THEN 'ambiguous' ELSE 'not_found' END END AS status
FROM orders LEFT JOIN (SELECT display_name, count(*) AS c FROM profiles GROUP BY 1) ON display_name = 'Member ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')"""))
def qry6(t: Tables):
    s = F.col("o_orderstatus")
    o = t.raw("orders")
    q = o.select(F.col("o_orderkey").alias("query_id"), F.when(s == "F", F.col("o_custkey").cast("string")).alias("anchor_person"),
                 F.when(s == "O", (F.col("o_custkey") % 8).cast("int")).alias("anchor_index"), F.when(s == "P", F.concat(
                     F.lit(" member "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("anchor_name"), "o_custkey")
    lists = q.filter("anchor_index IS NOT NULL").select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("position")).select(
        "query_id", F.lit("shortlist").alias("pool"), "position", (F.col("position") * 10).cast("string").alias("person_id"), F.lit("nobody").alias("name"))
    named = q.filter("anchor_name IS NOT NULL").withColumn("name", F.concat(F.lit("Member "), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    people = named.join(t.profiles().select(F.col("display_name").alias("name"), F.col("profile_id").alias("person_id")), "name").select(
        "query_id", F.lit("results").alias("pool"), F.lit(None).cast("int").alias("position"), "person_id", "name")
    return intent.resolve_anchors(q.drop("o_custkey"), lists.unionByName(people)).select("query_id", "status")


def refine_texts(t: Tables):
    c = t.raw("conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.concat(
        "text", F.when(F.col("role") == "user", " 必须会speed。不要noise，3年以上 python github 最近活跃 参考 2 号").otherwise(" prefer calm")).alias("text"),
        F.when(F.col("turn") % 3 == 0, "tighten").when(F.col("turn") % 3 == 1, "relax").otherwise("edit").alias("mode"))


SK = "CASE WHEN contains(l, 'ing') THEN ['ing'] ELSE [] END || CASE WHEN contains(l, 'tion') THEN ['tion'] ELSE [] END || CASE WHEN u THEN ['python'] ELSE [] END"
EXTRACT = f"""ext AS (SELECT query_id, md, {SK} AS skills, CASE WHEN u THEN '3年以上' END AS experience, CASE WHEN u THEN 'github' END AS source_bias,
  CASE WHEN u THEN ['speed'] ELSE [] END AS must_have, CASE WHEN u THEN [] ELSE ['calm'] END AS nice_to_have, CASE WHEN u THEN ['noise'] ELSE [] END AS exclude,
  u OR regexp_matches(l, 'fresh|recent|active') AS prefer_fresh, CASE WHEN u THEN 2 END AS anchor_index,
  u OR regexp_matches(l, 'java|go|rust|cuda|llm|rag') AS ax_skill, u OR regexp_matches(l, 'fresh|recent') AS ax_fresh FROM (SELECT conv_id || '-' || turn AS query_id, lower(text) AS l, role = 'user' AS u,
    CASE turn % 3 WHEN 0 THEN 'tighten' WHEN 1 THEN 'relax' ELSE 'edit' END AS md FROM conversations))"""
REFINE_VOCAB = {"skills": ["ing", "tion", "python"]}


@query("qry7_condition_extraction", with_sql([], """
SELECT query_id, skills, experience, source_bias, must_have, nice_to_have, exclude, prefer_fresh, anchor_index FROM ext""", EXTRACT))
def qry7(t: Tables):
    return intent.extract_conditions(refine_texts(t), **REFINE_VOCAB).select(
        "query_id", "skills", "experience", "source_bias", "must_have", "nice_to_have", "exclude", "prefer_fresh", "anchor_index")


@query("qry8_condition_revision", with_sql([], """
SELECT query_id, CASE WHEN md = 'tighten' THEN list_sort(list_distinct(['base'] || skills)) WHEN md = 'relax' THEN CASE WHEN ax_skill THEN list_sort(skills) ELSE ['base'] END
    ELSE CASE WHEN length(skills) > 0 THEN list_sort(skills) ELSE ['base'] END END AS skills,
  CASE WHEN md = 'relax' THEN '5年' WHEN u THEN '3年以上' ELSE '5年' END AS experience, CASE WHEN u THEN 'github' ELSE 'bonjour' END AS source_bias,
  list_sort(list_distinct(['core'] || must_have)) AS must_have, list_sort(exclude) AS exclude, CASE WHEN md = 'relax' THEN ax_fresh AND prefer_fresh ELSE prefer_fresh END AS prefer_fresh
FROM (SELECT *, source_bias IS NOT NULL AS u FROM ext)""", EXTRACT))
def qry8(t: Tables):
    texts = refine_texts(t)
    empty = F.array().cast("array<string>")
    current = texts.select("query_id", F.array(F.lit("base")).alias("skills"), empty.alias("locations"), F.array(F.lit("core")).alias("must_have"),
                           empty.alias("nice_to_have"), empty.alias("exclude"), F.lit(None).cast("string").alias("role"), F.lit("5年").alias("experience"),
                           F.lit("bonjour").alias("source_bias"), F.lit(False).alias("prefer_fresh"))
    # An experience word ('年限') is not in the instructions, so relax keeps the current experience.
    r = intent.revise_conditions(current, texts, **REFINE_VOCAB)
    return r.select("query_id", F.array_sort("skills").alias("skills"), "experience", "source_bias", F.array_sort("must_have").alias("must_have"),
                    F.array_sort("exclude").alias("exclude"), "prefer_fresh")


# --- retrieval ------------------------------------------------------------------------------
INDEX_NORM = r"trim(regexp_replace(lower({0}), '[\s\p{{P}}\p{{S}}]+', ' ', 'g'))"
WORD = "regexp_matches({0}, '(^|[^A-Za-z0-9_])' || {1} || '($|[^A-Za-z0-9_])')"
SPECIAL = " OR ".join(f"contains({{0}}, '{w}')" for w in ("rag", "retrieval", "multimodal", "multi modal", "computer vision", "llm"))
STRONG = "list_filter(skills, lambda s: length(s) >= 4)"
RETRIEVE = f"""
q AS (SELECT *, {NORM_SQL.format('raw_query')} AS nq, {TRI.format("raw_query || ' ' || array_to_string(roles || skills || must_haves, ' ')")} AS qt,
  {STRONG} AS terms FROM queries),
d AS (SELECT *, {INDEX_NORM.format('doc_text')} AS norm FROM search_docs WHERE status = 'active'),
dt AS (SELECT *, {TRI.format('norm')} AS tri FROM d),
ok AS (SELECT query_id, person_id, qt, tri, q.skills, q.roles, terms, norm, facet_role, facet_tags, facet_source, nq, q.source_bias FROM q, dt
  WHERE (length(locations) = 0 OR contains(location, 'en')) AND (source_bias IS NULL OR contains(facet_source, source_bias))
    AND (length(must_haves) = 0 OR contains(norm, 'of the'))),
sig AS (SELECT query_id, person_id, length(list_intersect(qt, tri)) / (length(qt) + length(tri) - length(list_intersect(qt, tri))) AS sim,
  length(list_intersect(roles, facet_role)) > 0 AS m_role, length(list_intersect(skills, facet_tags)) > 0 AS m_skill,
  length(list_filter(terms, lambda s: CASE WHEN length(s) <= 8 AND regexp_full_match(s, '[a-z0-9]+') THEN {WORD.format('norm', 's')} ELSE contains(norm, s) END)) > 0 AS m_skill_text,
  contains(facet_source, 'github') AND ({SPECIAL.format("nq || ' ' || array_to_string(skills, ' ')")}) AS code_special FROM ok),
kw_all AS (SELECT *, sim + m_role::INT * 0.08::DOUBLE + m_skill::INT * 0.12::DOUBLE + m_skill_text::INT * 0.10::DOUBLE + (code_special AND m_skill_text)::INT * 0.12::DOUBLE AS rank_score
  FROM sig WHERE sim > 0.08::DOUBLE OR m_role OR m_skill OR m_skill_text),
kw AS (SELECT *, least(1.0, rank_score) AS keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, person_id) AS rank FROM kw_all) WHERE rank <= 50)"""
VECTOR = """
vec_all AS (SELECT v.query_id, d.person_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS sim
  FROM query_vectors v JOIN q ON q.query_id = v.query_id CROSS JOIN d JOIN doc_embeddings e ON e.person_id = d.person_id
  WHERE (length(locations) = 0 OR contains(location, 'en')) AND (source_bias IS NULL OR contains(facet_source, source_bias))
    AND (length(must_haves) = 0 OR contains(norm, 'of the'))),
vec AS (SELECT query_id, person_id, least(1.0, greatest(0.0, round(sim, 9))) AS vector_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, person_id) AS rank FROM vec_all) WHERE rank <= 50)"""
HYBRID = f"""
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, person_id) AS rank FROM (
  SELECT query_id, person_id, coalesce(keyword_score, 0) AS keyword_score, coalesce(vector_score, 0) AS vector_score,
    coalesce(keyword_score, 0) * CASE WHEN sp AND source_bias IS NOT NULL THEN 0.58::DOUBLE WHEN sp THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END
    + coalesce(vector_score, 0) * CASE WHEN sp AND source_bias IS NOT NULL THEN 0.42::DOUBLE WHEN sp THEN 0.15::DOUBLE ELSE 0.6::DOUBLE END AS combined_score
  FROM (SELECT query_id, person_id, keyword_score FROM kw) FULL JOIN (SELECT query_id, person_id, vector_score FROM vec) USING (query_id, person_id)
  JOIN (SELECT query_id, source_bias, ({SPECIAL.format("nq || ' ' || array_to_string(skills, ' ')")}) AS sp FROM q) USING (query_id))) WHERE rank <= 50)"""
NEED = ["queries", "search_docs", "query_vectors", "doc_embeddings"]


def prepared(t: Tables):
    return retrieve.prepare_queries(t.queries())


def keyword(t: Tables):
    return retrieve.keyword_hits(prepared(t), t.search_docs())


def vector(t: Tables):
    return retrieve.vector_hits(prepared(t), t.query_vectors(), t.search_docs(), t.embeddings())


def hybrid(t: Tables):
    p = prepared(t)
    return retrieve.hybrid_hits(p, retrieve.keyword_hits(p, t.search_docs()),
                                retrieve.vector_hits(p, t.query_vectors(), t.search_docs(), t.embeddings()))


@query("ret1_keyword_candidates", with_sql(["queries", "search_docs"], """
SELECT query_id, person_id, round(sim, 6) AS sim, m_role, m_skill, m_skill_text, code_special AND m_skill_text AS m_specialized FROM kw""", RETRIEVE))
def ret1(t: Tables):
    return keyword(t).select("query_id", "person_id", F.round("sim", 6).alias("sim"), "m_role", "m_skill", "m_skill_text", "m_specialized")


@query("ret2_keyword_scores", with_sql(["queries", "search_docs"], """
SELECT query_id, person_id, rank, round(rank_score, 6) AS rank_score, round(keyword_score, 6) AS keyword_score FROM kw""", RETRIEVE))
def ret2(t: Tables):
    return keyword(t).select("query_id", "person_id", "rank", F.round("rank_score", 6).alias("rank_score"), F.round("keyword_score", 6).alias("keyword_score"))


@query("flt9_similarity_threshold", with_sql(["search_docs"], f"""
SELECT part, type, round(sim, 6) AS sim FROM (SELECT a.n AS part, b.ty AS type, length(list_intersect(ta, tb)) / (length(ta) + length(tb) - length(list_intersect(ta, tb))) AS sim
  FROM (SELECT DISTINCT p_name AS n, {TRI.format('p_name')} AS ta FROM part) a, (SELECT DISTINCT p_brand AS ty, {TRI.format("p_brand || ' ' || p_name")} AS tb FROM part) b) WHERE sim > 0.08 AND FALSE
UNION ALL SELECT p_name, p_brand, round(length(list_intersect(ta, tb)) / (length(ta) + length(tb) - length(list_intersect(ta, tb))), 6) FROM (SELECT DISTINCT p_name, p_brand, p_type, {TRI.format('p_name')} AS ta, {TRI.format("p_type || ' ' || p_brand || ' ring'")} AS tb FROM part)
  WHERE length(list_intersect(ta, tb)) / (length(ta) + length(tb) - length(list_intersect(ta, tb))) > 0.08"""))
def flt9(t: Tables):
    from ..functions.similarity import trigram_similarity
    sim = trigram_similarity("p_name", F.concat_ws(" ", "p_type", "p_brand", F.lit("ring")))
    rows = t.raw("part").select("p_name", "p_brand", "p_type").distinct().withColumn("sim", sim).filter("sim > 0.08")
    return rows.select(F.col("p_name").alias("part"), F.col("p_brand").alias("type"), F.round("sim", 6).alias("sim"))


@query("tk1_keyword_top_k", with_sql(["queries", "search_docs"], "SELECT query_id, person_id, rank FROM kw WHERE rank <= 10", RETRIEVE))
def tk1(t: Tables):
    from dataclasses import replace
    from ..config import DEFAULT
    return retrieve.keyword_hits(prepared(t), t.search_docs(), replace(DEFAULT.retrieval, limit=10)).select("query_id", "person_id", "rank")


@query("tk2_vector_top_k", with_sql(["query_vectors", "doc_embeddings"], """
SELECT query_id, person_id, round(sim, 6) AS vector_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, person_id) AS rank FROM (
  SELECT query_id, person_id, greatest(0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) AS sim FROM query_vectors v, doc_embeddings e)) WHERE rank <= 50"""))
def tk2(t: Tables):
    # No filters: every embedded row is a candidate.
    bare = t.query_vectors().select("query_id", F.lit("").alias("raw_query"), *[F.array().cast("array<string>").alias(c) for c in (
        "roles", "skills", "locations", "must_haves", "nice_to_haves")], F.lit(None).cast("string").alias("source_bias"))
    rows = t.embeddings().select("person_id", F.lit("").alias("doc_text"), *[F.array().cast("array<string>").alias(c) for c in (
        "facet_location", "facet_source")], F.lit("").alias("location"), F.lit("active").alias("status"))
    hits = retrieve.vector_hits(retrieve.prepare_queries(bare), t.query_vectors(), rows, t.embeddings())
    return hits.select("query_id", "person_id", F.round("vector_score", 6).alias("vector_score"), "rank")


@query("ret3_vector_hits", with_sql(NEED, "SELECT query_id, person_id, round(vector_score, 6) AS vector_score, rank FROM vec", RETRIEVE + "," + VECTOR))
def ret3(t: Tables):
    return vector(t).select("query_id", "person_id", F.round("vector_score", 6).alias("vector_score"), "rank")


@query("jn11_channel_merge", with_sql(NEED, """
SELECT query_id, person_id, round(coalesce(keyword_score, 0), 6) AS keyword_score, round(coalesce(vector_score, 0), 6) AS vector_score
FROM (SELECT query_id, person_id, keyword_score FROM kw) FULL JOIN (SELECT query_id, person_id, vector_score FROM vec) USING (query_id, person_id)""", RETRIEVE + "," + VECTOR))
def jn11(t: Tables):
    from dataclasses import replace
    from ..config import DEFAULT
    p = prepared(t)
    merged = retrieve.hybrid_hits(p, keyword(t), vector(t), replace(DEFAULT.retrieval, limit=100))
    return merged.select("query_id", "person_id", F.round("keyword_score", 6).alias("keyword_score"), F.round("vector_score", 6).alias("vector_score"))


@query("ret4_hybrid_merge", with_sql(NEED, """
SELECT query_id, person_id, rank, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(combined_score, 6) AS combined_score FROM hyb""", RETRIEVE + "," + VECTOR + "," + HYBRID))
def ret4(t: Tables):
    return hybrid(t).select("query_id", "person_id", "rank", *[F.round(c, 6).alias(c) for c in ("keyword_score", "vector_score", "combined_score")])


@query("tk3_merged_top_k", with_sql(NEED, "SELECT query_id, person_id, rank FROM hyb WHERE rank <= 10", RETRIEVE + "," + VECTOR + "," + HYBRID))
def tk3(t: Tables):
    return hybrid(t).filter("rank <= 10").select("query_id", "person_id", "rank")


@query("ret5_warnings", with_sql(NEED, """
SELECT query_id, coalesce(nk, 0) AS n_keyword, coalesce(nv, 0) AS n_vector, CASE WHEN coalesce(nv, 0) = 0 AND coalesce(nk, 0) > 0 THEN ['vector_search_empty']
  WHEN coalesce(nv, 0) = 0 AND coalesce(nk, 0) = 0 THEN ['keyword_search_empty'] ELSE [] END AS warnings
FROM queries LEFT JOIN (SELECT query_id, count(*) AS nk FROM kw GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS nv FROM vec GROUP BY 1) USING (query_id)""", RETRIEVE + "," + VECTOR))
def ret5(t: Tables):
    return retrieve.retrieval_warnings(prepared(t), keyword(t), vector(t))


@query("ret6_fallback_search", with_sql(["search_docs"], r"""
SELECT person_id, least(100, 35 + 30 + 10 + (regexp_matches(lower(doc_text || ' ' || headline), '(^|[^A-Za-z0-9_])writer($|[^A-Za-z0-9_])') OR contains(facet_role, 'writer'))::INT * 15
  + CASE (regexp_matches(lower(doc_text), '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') OR contains(facet_tags, 'the'))::INT + regexp_matches(lower(doc_text), '(^|[^A-Za-z0-9_])zzz($|[^A-Za-z0-9_])')::INT WHEN 0 THEN 0 WHEN 1 THEN 13 ELSE 25 END
  + 4 * (regexp_matches(lower(doc_text), '(^|[^A-Za-z0-9_])and($|[^A-Za-z0-9_])') OR contains(facet_tags, 'and'))::INT) AS score
FROM search_docs WHERE status = 'active' AND contains(location, 'en') AND contains(facet_source, 'github') AND contains(lower(doc_text), 'the') ORDER BY score DESC, person_id LIMIT 30"""))
def ret6(t: Tables):
    return retrieve.fallback_hits(t.search_docs(), locations=["EN"], source_bias="github", must=["the"], role="writer",
                                  skills=["the", "zzz"], nice=["and"], limit=30)


@query("ret7_disambiguation", with_sql(["profiles"], """
SELECT query_id, person_id, group_size, '重名提示：同名候选共 ' || group_size || ' 个；当前是 ' || label || CASE WHEN length(o) > 0 THEN '；其他还有 ' || array_to_string(o[1:2], ' / ') ELSE '' END || '。' AS note
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS group_size, list_filter(list_distinct_ordered, lambda x: x <> label OR n_label > 1) AS o FROM (
  SELECT a.*, (SELECT count(*) FROM c b WHERE b.query_id = a.query_id AND b.label = a.label) AS n_label,
    (SELECT list(label ORDER BY f, label) FROM (SELECT label, min(rk) AS f FROM c b WHERE b.query_id = a.query_id GROUP BY 1 ORDER BY f, label LIMIT 3)) AS list_distinct_ordered FROM c a))
WHERE group_size > 1""", """c AS (SELECT display_name AS query_id, profile_id AS person_id, CASE WHEN headline IS NOT NULL THEN headline ELSE '来源 ' || source END AS label,
  CASE WHEN source = 'bonjour' THEN 1 ELSE 2 END AS rk FROM profiles)"""))
def ret7(t: Tables):
    rows = t.profiles().select(F.col("display_name").alias("query_id"), F.concat(F.lit("find "), F.col("display_name")).alias("raw_query"),
                               F.col("profile_id").alias("person_id"), F.when(F.col("source") == "bonjour", 1).otherwise(2).alias("rank"),
                               F.col("display_name").alias("name"), "headline", F.array().cast("array<string>").alias("reasons"), F.array("source").alias("facet_source"))
    return retrieve.disambiguation_notes(rows)


# --- ranking --------------------------------------------------------------------------------
BOOST = f"""
items AS (SELECT h.query_id, h.person_id, e.*, list_filter(q.skills, lambda s: contains({NORM_SQL.format("title || ' ' || description")}, s)) AS found, contains(q.skills, language) AS lang_hit
  FROM hyb h JOIN q ON q.query_id = h.query_id JOIN evidence e ON e.person_id = h.person_id),
agg AS (SELECT query_id, person_id, count_if(evidence_type = 'project' AND (length(found) > 0 OR lang_hit)) AS np, count_if(evidence_type = 'repository' AND (length(found) > 0 OR lang_hit)) AS nr,
  sum(followers) AS fol, list_distinct(flatten(list(found))) AS ev_skills, arg_min(title, evidence_id) FILTER (evidence_type = 'project') AS project_title,
  bool_or(evidence_type = 'repository') AS has_repo FROM items GROUP BY 1, 2),
scored AS (SELECT h.*, d.facet_role, d.facet_tags, d.doc_text, q.skills, q.roles, q.must_haves, ev_skills, project_title, lead,
  coalesce(np, 0) * 0.08::DOUBLE + coalesce(nr, 0) * 0.04::DOUBLE + CASE WHEN lead THEN 0.08 ELSE 0.0 END::DOUBLE + 0.02::DOUBLE * log10(coalesce(fol, 0) + 1) AS evidence_boost,
  greatest(0.35::DOUBLE, exp(-d.freshness / 365.0::DOUBLE)) AS freshness_factor
  FROM hyb h JOIN q ON q.query_id = h.query_id JOIN d ON d.person_id = h.person_id LEFT JOIN agg ON agg.query_id = h.query_id AND agg.person_id = h.person_id
  JOIN (SELECT hh.query_id AS lq, hh.person_id AS lp, contains(q2.nq || ' ' || array_to_string(q2.roles, ' '), 'lead') AND contains(d2.norm, 'lead') AS lead FROM hyb hh JOIN q q2 ON q2.query_id = hh.query_id JOIN d d2 ON d2.person_id = hh.person_id) ON lq = h.query_id AND lp = h.person_id),
final AS (SELECT *, combined_score * (1 + evidence_boost) * freshness_factor AS final_score FROM scored)"""
RANK_NEED = NEED + ["evidence"]
RANK_SQL = RETRIEVE + "," + VECTOR + "," + HYBRID + "," + BOOST


def ranked(t: Tables):
    return rank.rerank(hybrid(t).drop("rank"), t.queries(), t.search_docs(), t.evidence().drop("stars"))


@query("rnk1_evidence_boost", with_sql(RANK_NEED, "SELECT query_id, person_id, round(evidence_boost, 6) AS evidence_boost FROM final", RANK_SQL))
def rnk1(t: Tables):
    return rank.score_hits(hybrid(t).drop("rank"), t.queries(), t.search_docs(), t.evidence()).select(
        "query_id", "person_id", F.round("evidence_boost", 6).alias("evidence_boost"))


@query("rnk2_final_score", with_sql(RANK_NEED, """
SELECT query_id, person_id, round(freshness_factor, 6) AS freshness_factor, round(final_score, 6) AS final_score FROM final""", RANK_SQL))
def rnk2(t: Tables):
    return ranked(t).select("query_id", "person_id", F.round("freshness_factor", 6).alias("freshness_factor"), F.round("final_score", 6).alias("final_score"))


SNIP = NORM_SQL.format("substr(regexp_replace(doc_text, '^\\s+|\\s+$', '', 'g'), 1, 280)")
REASONS = f"""list_transform(list_filter(roles, lambda r: length(list_filter(facet_role, lambda v: contains(v, r))) > 0 OR contains({SNIP}, r)), lambda x: 'role match: ' || x)
  || CASE WHEN lead THEN ['tech lead evidence'] ELSE [] END
  || list_transform(list_filter(skills, lambda s: contains(facet_tags, s) OR contains(coalesce(ev_skills, []), s)), lambda x: 'skill evidence: ' || x)
  || list_transform(list_filter(must_haves, lambda m: contains({SNIP}, m)), lambda x: 'must-have matched: ' || x)
  || CASE WHEN vector_score >= 0.75 THEN ['strong semantic similarity'] ELSE [] END || CASE WHEN keyword_score >= 0.5 THEN ['strong keyword overlap'] ELSE [] END
  || CASE WHEN project_title IS NOT NULL THEN ['project: ' || project_title] ELSE [] END"""


@query("rnk3_match_reasons", with_sql(RANK_NEED, f"""
SELECT query_id, person_id, rank() OVER (PARTITION BY query_id ORDER BY final_score DESC, person_id) AS rank, ({REASONS})[1:5] AS match_reasons FROM final""", RANK_SQL))
def rnk3(t: Tables):
    return ranked(t).select("query_id", "person_id", "rank", "match_reasons")


@query("rnk4_pair_scoring")
def rnk4(t: Tables):
    intents, docs = t.queries(), t.search_docs()
    hits = cut_lineage(hybrid(t).drop("rank"))
    scored = rank.score_hits(hits, intents, docs, t.evidence())
    texts = rank.candidate_texts(docs, docs.select("person_id", "facet_role", "facet_tags"), t.evidence())
    pairs = rank.pair_candidates(scored, intents, texts)
    final = rank.rerank(hits, intents, docs, t.evidence(), pair_scores=udfs.score_pairs(pairs))
    return final.select("query_id", "person_id", "rank", F.round("final_score", 6).alias("final_score"), "pair_score")


@query("rnk5_candidate_text", with_sql(["persons", "evidence"], """
SELECT person_id, 'Name: ' || name || chr(10) || 'Headline: ' || headline || chr(10) || 'Location: ' || location || chr(10) || 'Roles: r' || coalesce(chr(10) || 'Work history: ' || w, '')
  || coalesce(chr(10) || 'Projects: ' || pr, '') || coalesce(chr(10) || 'Repos: ' || re, '') || coalesce(chr(10) || 'Latest evidence: ' || strftime(latest, '%Y-%m-%d'), '') AS candidate_text
FROM persons LEFT JOIN (SELECT person_id, string_agg(line, '; ' ORDER BY slot) FILTER (evidence_type = 'experience') AS w, string_agg(line, '; ' ORDER BY slot) FILTER (evidence_type = 'project') AS pr,
    string_agg(line, '; ' ORDER BY slot) FILTER (evidence_type = 'repository') AS re FROM (
  SELECT person_id, evidence_type, row_number() OVER (PARTITION BY person_id, evidence_type ORDER BY CASE WHEN evidence_type = 'experience' THEN -epoch_us(occurred_at) ELSE 0 END, evidence_id) AS slot,
    CASE evidence_type WHEN 'experience' THEN title || ' [' || strftime(occurred_at, '%Y-%m-%d') || ']: ' || description WHEN 'project' THEN title || ': ' || description
      ELSE title || ' (' || language || ', 0 stars) — ' || description END AS line FROM evidence WHERE evidence_type IN ('experience', 'project', 'repository')) WHERE slot <= 3 GROUP BY 1) USING (person_id)
LEFT JOIN (SELECT person_id, max(occurred_at) AS latest FROM evidence WHERE evidence_type IN ('project', 'repository') GROUP BY 1) USING (person_id)"""))
def rnk5(t: Tables):
    docs = t.persons().select("person_id", F.array(F.lit("r")).alias("facet_role"), F.array().cast("array<string>").alias("facet_tags"))
    return rank.candidate_texts(t.persons(), docs, t.evidence())


