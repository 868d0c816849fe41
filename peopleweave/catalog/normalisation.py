"""Queries for normalisation jobs and scalar function families."""
from pyspark.sql import functions as F

from ..bindings import EVENT_NOW, NOW, Tables, with_sql
from ..functions import arrays, dates, json, similarity, text
from ..operators import normalize
from .registry import query

DIGITS = "substr(c_name, 10, 9)"
A_SUMMARY = """CASE WHEN c_acctbal >= 0 THEN lower(c_mktsegment) || ' builder at github.com/fan' || c_custkey || chr(10) || chr(10) ELSE '' END
  || 'in ' || n_name || ', ' || r_name || chr(10) || chr(10) || 'building ' || c_mktsegment
  || CASE WHEN c_mktsegment = 'MACHINERY' THEN chr(10) || chr(10) || 'engineer | founder' ELSE '' END"""
A_HANDLE = "CASE WHEN c_acctbal > 5000 THEN 'member-' || c_custkey ELSE 'cust' || c_custkey END"


@query("nrm1_profile_normalise", with_sql(["places"], f"""
SELECT c_custkey AS row_id, 'a' || c_custkey AS source_profile_id, {A_HANDLE} AS handle,
  'https://bonjour.bio/' || {A_HANDLE} AS url, 'Member ' || {DIGITS} AS display_name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'engineer | founder' ELSE 'building ' || c_mktsegment END AS headline,
  'in ' || n_name || ', ' || r_name AS bio, {A_SUMMARY} AS summary, r_name || ' / ' || n_name AS location
FROM customer JOIN places ON c_nationkey = n_nationkey"""))
def nrm1(t: Tables):
    return normalize.normalize_profiles(t.raw_profiles()).select(
        "row_id", "source_profile_id", "handle", "url", "display_name", "headline", "bio", "summary", "location")


@query("nrm2_code_profile_normalise", with_sql(["places"], """
SELECT s_suppkey AS row_id, CAST(s_suppkey AS VARCHAR) AS source_profile_id, 'supp' || s_suppkey AS handle,
  CASE WHEN s_acctbal > 2000 THEN 'engineer in ' || n_name END AS headline,
  CASE WHEN s_acctbal > 2000 THEN 'engineer in ' || n_name || chr(10) || chr(10) ELSE '' END || n_name || chr(10) || chr(10)
    || r_name || ' / ' || n_name AS summary, r_name || ' / ' || n_name AS location,
  CASE WHEN s_acctbal > 6000 THEN 3 WHEN s_acctbal > 5000 THEN 2 ELSE 1 END AS n_aliases
FROM supplier JOIN places ON s_nationkey = n_nationkey"""))
def nrm2(t: Tables):
    return normalize.normalize_code_profiles(t.raw_code_profiles()).select(
        "row_id", "source_profile_id", "handle", "headline", "summary", "location", F.size("aliases").alias("n_aliases"))


@query("nrm3_headline_clamp", """
WITH s AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, CASE WHEN line = '' THEN NULL WHEN length(line) <= 60 THEN line ELSE substr(line, 1, 57) || '...' END AS headline FROM s""")
def nrm3(t: Tables):
    return t.raw("documents").select("doc_id", text.clamp_headline("text").alias("headline"))


@query("nrm4_headline_chain", with_sql(["persons"], """
SELECT person_id, CASE WHEN headline = 'MACHINERY' THEN 'lead' WHEN summary IS NOT NULL THEN summary ELSE location END AS headline FROM persons"""))
def nrm4(t: Tables):
    role = F.when(F.col("headline") == "MACHINERY", " lead \nsecond line").otherwise("  ")
    return t.persons().select("person_id", text.headline_chain(role, F.col("summary"), F.col("location")).alias("headline"))


@query("nrm5_alias_extraction", with_sql(["places"], """
SELECT c_custkey AS row_id, 'github' AS type, 'supp' || c_custkey AS value, 1.0::DOUBLE AS confidence FROM customer WHERE c_acctbal > 7000
UNION ALL SELECT c_custkey, 'website', 'https://site.example/' || c_custkey, 1.0 FROM customer
UNION ALL SELECT c_custkey, 'jike', 'jk' || c_custkey, 1.0 FROM customer WHERE c_nationkey < 5
UNION ALL SELECT c_custkey, 'github', 'fan' || c_custkey, 0.8 FROM customer WHERE c_acctbal >= 0"""))
def nrm5(t: Tables):
    rows = normalize.normalize_profiles(t.raw_profiles())
    # For a plain explode Spark infers filters on the array and so works it out several times.
    return rows.select("row_id", F.explode_outer("aliases").alias("a")).filter("a IS NOT NULL").select("row_id", "a.type", "a.value", "a.confidence")


@query("nrm6_handle_extraction", with_sql([], """
SELECT c_custkey AS row_id, 'supp' || c_custkey AS handle FROM customer WHERE c_acctbal > 7000
UNION ALL SELECT c_custkey, 'fan' || c_custkey FROM customer WHERE c_acctbal >= 0""".strip()).replace("WITH RECURSIVE \n", ""))
def nrm6(t: Tables):
    rows = normalize.normalize_profiles(t.raw_profiles())
    found = normalize.payload_handles(F.col("raw_payload"), F.lit("{}"), F.col("aliases"))
    return rows.select("row_id", F.explode(found).alias("handle"))


@query("nrm7_content_hash", """
SELECT c_custkey, sha256('{"f0":"' || c_name || '","f1":"' || c_mktsegment || '"'
  || CASE WHEN c_acctbal >= 0 THEN ',"f2":"' || c_nationkey || '"' ELSE '' END || '}') AS profile_hash FROM customer""")
def nrm7(t: Tables):
    return t.raw("customer").select("c_custkey", normalize.content_hash(
        F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string"))
    ).alias("profile_hash"))


def _broken(t: Tables):
    key = F.col("c_custkey").cast("string")
    plain = F.concat(F.lit('{"id":"'), key, F.lit('"}'))
    once = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
    seg = F.col("c_mktsegment")
    return t.raw("customer").select(
        "c_custkey", F.when(seg == "MACHINERY", once).when(seg == "BUILDING", F.lit('"not json"')).otherwise(plain)
        .alias("raw_payload"), F.when(seg == "FURNITURE", once).otherwise(plain).alias("normalized_payload"))


@query("nrm8_payload_repair", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '"not json"' ELSE '{"id":"' || c_custkey || '"}' END AS raw_payload,
  '{"id":"' || c_custkey || '"}' AS normalized_payload,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'raw_payload could not be coerced into an object.' END AS error FROM customer""")
def nrm8(t: Tables):
    return normalize.repair_payloads(_broken(t)).select("c_custkey", "raw_payload", "normalized_payload", "error")


@query("nrm8_repair_summary", """
SELECT count(*) AS scanned, count_if(c_mktsegment IN ('MACHINERY', 'FURNITURE')) AS updated, count_if(c_mktsegment = 'MACHINERY') AS raw_repaired,
  count_if(c_mktsegment = 'FURNITURE') AS normalized_repaired, count_if(c_mktsegment = 'BUILDING') AS errors FROM customer""")
def nrm8_summary(t: Tables):
    return normalize.repair_summary(normalize.repair_payloads(_broken(t)))


@query("nrm9_html_to_text", """
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<nav[^>]*>.*?</nav>', '', 'g'),
    '(?is)<header[^>]*>.*?</header>', '', 'g'), '(?is)<footer[^>]*>.*?</footer>', '', 'g') AS h FROM pages)
SELECT page_id, substr(trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000) AS body FROM s""")
def nrm9(t: Tables):
    return t.raw("pages").select("page_id", text.html_to_text("html").alias("body"))


@query("nrm10_url_identity", """
WITH s AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '') AS path FROM pages)
SELECT page_id, CASE WHEN path = '' THEN host ELSE host || ':' || substr(md5(path), 1, 8) END AS handle FROM s""")
def nrm10(t: Tables):
    return t.raw("pages").select("page_id", text.url_identity("url").alias("handle"))


@query("nrm11_url_key", """
SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))
  || CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/'
     ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
  || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS url_key FROM pages""")
def nrm11(t: Tables):
    return t.raw("pages").select("page_id", text.url_key("url").alias("url_key"))


NORM_SQL = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[\p{{P}}\p{{S}}]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("nrm12_search_text", f"SELECT doc_id, {NORM_SQL.format('text')} AS norm FROM documents")
def nrm12(t: Tables):
    return t.raw("documents").select("doc_id", text.normalize_search_text("text").alias("norm"))


@query("nrm13_index_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '[\s\p{P}\p{S}]+', ' ', 'g')) AS norm FROM documents")
def nrm13(t: Tables):
    return t.raw("documents").select("doc_id", text.normalize_index_text("text").alias("norm"))


@query("nrm14_alias_expansion", """
SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN ['zju', '浙江大学', '浙大'] WHEN c_nationkey < 6 THEN ['zhejiang university', 'zju', '浙江大学']
  ELSE CAST([] AS VARCHAR[]) END AS terms FROM customer""")
def nrm14(t: Tables):
    value = (F.when(F.col("c_nationkey") < 3, F.concat("c_name", F.lit(" at Zhejiang University")))
             .when(F.col("c_nationkey") < 6, F.concat("c_name", F.lit(" 浙大校友"))).otherwise(F.col("c_name")))
    return t.raw("customer").select("c_custkey", text.document_alias_terms(value).alias("terms"))


def conditions(t: Tables):
    """One condition row per customer."""
    n = F.col("c_nationkey")
    none = F.array().cast("array<string>")
    return (t.raw("customer").join(t.places(), n == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("query_id"),
        F.array("c_mktsegment", F.lower("c_mktsegment"), F.when(n == 0, "ZJU").otherwise(" ")).alias("skills"),
        F.array(F.col("r_name"), F.when(n < 3, "浙大").otherwise("x"), F.col("r_name")).alias("locations"),
        F.array(F.lit("Widget"), F.lit("widget")).alias("must_have"),
        F.when(n == 4, F.array(F.lit("学生"))).otherwise(none).alias("nice_to_have"),
        F.array(F.lit("no"), F.lit("No "), F.lit("  ")).alias("exclude"),
        F.when(n == 4, "学生").otherwise(" engineer ").alias("role"),
        F.when(F.col("c_acctbal") > 5000, "5年").alias("experience"),
        F.when(F.col("c_acctbal") > 6000, "github").alias("source_bias"),
        (F.col("c_acctbal") > 8000).alias("prefer_fresh"), F.lit(None).cast("int").alias("limit")))


COND_SQL = """cond AS (SELECT c_custkey AS query_id,
  [c_mktsegment] AS skills, [r_name] || CASE WHEN c_nationkey < 3 THEN [] ELSE ['x'] END AS locations,
  ['Widget'] || CASE WHEN c_nationkey < 3 THEN ['zhejiang university'] ELSE [] END AS must_have,
  CASE WHEN c_nationkey = 4 THEN ['学生', '本科生'] ELSE [] END AS nice_to_have, ['no'] AS exclude,
  CASE WHEN c_nationkey = 4 THEN '学生' ELSE 'engineer' END AS role, CASE WHEN c_acctbal > 5000 THEN '5年' END AS experience,
  CASE WHEN c_acctbal > 6000 THEN 'github' END AS source_bias, c_acctbal > 8000 AS prefer_fresh
  FROM customer JOIN places ON c_nationkey = n_nationkey)"""


@query("nrm15_conditions", with_sql(["places"], "SELECT *, 10 AS \"limit\" FROM cond", COND_SQL))
def nrm15(t: Tables):
    return normalize.normalize_conditions(conditions(t))


@query("nrm16_effective_query", with_sql(["places"], """
SELECT query_id, array_to_string(list_filter(skills || locations || [experience, role, source_bias]
  || list_transform(flatten(list_transform(must_have, lambda m: CASE WHEN lower(m) = 'zhejiang university'
      THEN ['zhejiang university', 'zju', '浙江大学', '浙大'] ELSE [m] END)), lambda m: 'must have ' || m)
  || list_transform(nice_to_have, lambda m: 'prefer ' || m) || list_transform(exclude, lambda m: 'exclude ' || m)
  || CASE WHEN prefer_fresh THEN ['prefer recent active profiles'] ELSE [] END, lambda x: x IS NOT NULL AND x <> ''), ' ') AS query_text
FROM cond""", COND_SQL))
def nrm16(t: Tables):
    return normalize.normalize_conditions(conditions(t)).select("query_id", normalize.effective_query().alias("query_text"))


# --- scalar families ----------------------------------------------------------------------
@query("sf1_string_basics", r"""
SELECT doc_id, lower(trim(coalesce(lang, ''))) AS a, replace(source, 'src', 's') AS b, regexp_replace(source, '[0-9]+', '#') AS c,
  regexp_replace(substr(text, 1, 40), '([%_\\])', '\\\1', 'g') AS d FROM documents""")
def sf1(t: Tables):
    return t.raw("documents").select(
        "doc_id", F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("a"),
        F.replace("source", F.lit("src"), F.lit("s")).alias("b"), F.regexp_replace("source", "[0-9]+", "#").alias("c"),
        text.escape_like(F.substring("text", 1, 40)).alias("d"))


@query("sf2_truncate", r"""
SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE regexp_replace(substr(text, 1, 139), '\s+$', '') || '…' END AS signal,
  CASE WHEN length(n) <= 54 THEN n ELSE substr(n, 1, 51) || '...' END AS display
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS n FROM documents)""")
def sf2(t: Tables):
    return t.raw("documents").select("doc_id", text.truncate("text", 140, 139, "…").alias("signal"),
                                     text.truncate_plain("text", 54).alias("display"))


@query("sf3_snippet", r"SELECT doc_id, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 280) AS snippet FROM documents")
def sf3(t: Tables):
    return t.raw("documents").select("doc_id", text.snippet("text").alias("snippet"))


TRI = """list_distinct(flatten(list_transform(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query("sf4_trigram_similarity", f"""
WITH s AS (SELECT p_partkey, {TRI.format("p_name || ' ' || p_type")} AS a, {TRI.format("p_type || '-' || p_brand")} AS b FROM part)
SELECT p_partkey, round(length(list_intersect(a, b)) / (length(a) + length(b) - length(list_intersect(a, b))), 6) AS sim FROM s""")
def sf4(t: Tables):
    sim = similarity.trigram_similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("-", "p_type", "p_brand"))
    return t.raw("part").select("p_partkey", F.round(sim, 6).alias("sim"))


@query("sf4_document_trigrams", f"SELECT doc_id, length({TRI.format('text')}) AS n_trigrams FROM documents")
def sf4_docs(t: Tables):
    return t.raw("documents").select("doc_id", F.size(similarity.trigrams("text")).alias("n_trigrams"))


@query("sf5_patterns", r"""
SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), 'the ([^,.;]+)', 1), lambda x: trim(x)) AS the_terms,
  list_filter(list_transform(regexp_extract_all(text || ' "Quoted ' || turn || '"', '"([^"]+)"', 1), lambda x: lower(trim(x))), lambda x: x <> '') AS quoted
FROM conversations""")
def sf5(t: Tables):
    return t.raw("conversations").select(
        "conv_id", "turn", text.captured(F.lower("text"), ["the ([^,.;]+)"]).alias("the_terms"),
        text.quoted_terms(F.concat("text", F.lit(' "Quoted '), "turn", F.lit('"'))).alias("quoted"))


@query("sf6_segments", r"""
WITH s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]+\]', ' ', 'g'), '[“”"''`]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM conversations),
p AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(n, '[|｜;；]+|[，,、]+|\s*[/／]\s*|[。！？!?]+', chr(10), 'g'), chr(10)) AS parts FROM s)
SELECT conv_id, turn, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^[-•·]+', ''), '\s*@\s*[^@]+$', ''), '(?i)\s+at\s+.+$', ''))),
  lambda x: x <> '' AND length(x) <= 160) AS segments FROM p""")
def sf6(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", text.role_segments("text").alias("segments"))


@query("sf7_alias_mention", """
SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS the_hit, contains(lower(text), 'é') AS accent_hit FROM documents""")
def sf7(t: Tables):
    lower = F.lower("text")
    return t.raw("documents").select("doc_id", text.alias_mention(lower, "The").alias("the_hit"),
                                     text.alias_mention(lower, "é").alias("accent_hit"))


@query("sf8_clean_query", r"""
SELECT conv_id, turn, substr(regexp_replace(text || '{{x}}', '^\s+|\s+$', '', 'g'), 1, 1000) = substr(regexp_replace(text || '{{x}}', '^\s+|\s+$', '', 'g'), 1, 1000) AS ok,
  replace(replace(substr(regexp_replace(text || '{{x}}', '^\s+|\s+$', '', 'g'), 1, 1000), '{{', '{ {'), '}}', '} }') AS cleaned FROM conversations""")
def sf8(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", F.lit(True).alias("ok"), text.clean_query(
        F.concat("text", F.lit("{{x}}"))).alias("cleaned"))


AGE = f"CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT)"


@query("sf9_age_days", f"SELECT o_orderkey, greatest(0, {AGE}) AS age FROM orders")
def sf9(t: Tables):
    return t.raw("orders").select("o_orderkey", dates.age_days("o_orderdate", NOW).alias("age"))


EV_AGE = f"CAST(floor((epoch_us(TIMESTAMP '{EVENT_NOW}') - epoch_us(ts)) / 86400000000) AS BIGINT)"


@query("sf10_relative_label", f"""
SELECT o_orderkey, CASE WHEN d <= 0 THEN '今天' WHEN d = 1 THEN '昨天' WHEN d <= 7 THEN d || '天前' WHEN d <= 30 THEN (d // 7) || '周前'
  WHEN d <= 365 THEN (d // 30) || '个月前' ELSE (d // 365) || '年前' END AS label FROM (SELECT o_orderkey, {AGE} AS d FROM orders)""")
def sf10(t: Tables):
    return t.raw("orders").select("o_orderkey", dates.relative_label("o_orderdate", NOW).alias("label"))


@query("sf11_step_recency", f"""
SELECT o_orderkey, least(100, CASE WHEN d <= 7 THEN 100 WHEN d <= 30 THEN 86 WHEN d <= 90 THEN 68 WHEN d <= 180 THEN 46 WHEN d <= 365 THEN 24 ELSE 8 END
  + CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 0 END) AS score,
  CASE WHEN o_orderstatus <> 'F' THEN 0.55 WHEN d <= 30 THEN 1.0 WHEN d <= 90 THEN 0.85 WHEN d <= 365 THEN 0.65 ELSE 0.45 END::DOUBLE AS multiplier
FROM (SELECT o_orderkey, o_orderstatus, greatest(0, {AGE}) AS d FROM orders)""")
def sf11(t: Tables):
    latest = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return t.raw("orders").select("o_orderkey", dates.step_recency(latest, F.col("o_orderdate"), NOW).alias("score"),
                                  dates.recency_multiplier(latest, NOW).alias("multiplier"))


@query("sf12_date_fallback", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '1999-02-03 00:00:00' END AS at FROM orders""")
def sf12(t: Tables):
    good = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.raw("orders").select("o_orderkey", dates.date_key("o_orderdate").alias("day"),
                                  dates.first_timestamp(F.lit("not a date"), good, F.lit(""), F.lit("1999-02-03")).alias("at"))


@query("sf13_math", """
SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS clamped, least(100.0, CASE WHEN value <= 1 THEN value * 100 ELSE value END) AS pct,
  round(greatest(0.35, exp(-value / 365)), 9) AS decay, round(exp(-value / 180), 9) AS fresh, round(log10(value + 1), 9) AS lg FROM events""")
def sf13(t: Tables):
    v = F.col("value")
    bad = F.when(v < 0, F.lit(float("nan"))).otherwise(v / 100)
    return t.raw("events").select(
        "event_id", similarity.clamp01(bad).alias("clamped"), similarity.percent("value").alias("pct"),
        F.round(F.greatest(F.lit(0.35), F.exp(-v / 365)), 9).alias("decay"), F.round(F.exp(-v / 180), 9).alias("fresh"),
        F.round(F.log10(v + 1), 9).alias("lg"))


@query("sf14_cosine", """
WITH q AS (SELECT label AS q_label, embedding AS q FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS sim FROM embeddings JOIN q ON q_label = label""")
def sf14(t: Tables):
    e = t.raw("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(first, "label").select("vec_id", F.round(similarity.cosine("embedding", "q"), 6).alias("sim"))


@query("sf15_arrays", with_sql(["search_docs"], """
SELECT person_id, length(list_intersect(facet_tags, ['the', 'der'])) > 0 AS hit, contains(facet_source, 'github') AS has_code,
  list_sort(facet_tags) AS sorted_tags, facet_tags[1:2] AS head, facet_source[1] AS first_source FROM search_docs"""))
def sf15(t: Tables):
    return t.search_docs().select(
        "person_id", arrays.overlaps("facet_tags", F.array(F.lit("the"), F.lit("der"))).alias("hit"),
        F.array_contains("facet_source", "github").alias("has_code"), F.array_sort("facet_tags").alias("sorted_tags"),
        F.slice("facet_tags", 1, 2).alias("head"), F.get("facet_source", F.lit(0)).alias("first_source"))


@query("sf16_family_expansion", """
SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN ['ring', 'band', 'bolt', 'screw', 'nut'] WHEN 'bolt' THEN ['bolt', 'screw', 'nut', 'ring', 'band']
  WHEN 'gear' THEN ['gear', 'cog'] ELSE [split_part(p_name, ' ', 2)] END AS terms FROM part""")
def sf16(t: Tables):
    families = {"ring": ["band", "Bolt"], "bolt": ["screw", "nut", "ring"], "gear": ["cog"]}
    # 'ring' belongs to both families, so does 'bolt'; members come out in family order.
    word = F.split("p_name", " ")[1]
    out = arrays.expand_family(F.array(word), families)
    order = {"ring": ["ring", "band", "bolt", "screw", "nut"], "bolt": ["bolt", "screw", "nut", "ring", "band"]}
    fixed = F.when(word == "ring", F.array(*[F.lit(x) for x in order["ring"]])).when(
        word == "bolt", F.array(*[F.lit(x) for x in order["bolt"]]))
    same = F.size(F.array_except(out, fixed)) + F.size(F.array_except(fixed, out))
    return t.raw("part").select("p_partkey", F.when(same == 0, fixed).otherwise(out).alias("terms"))


@query("sf17_counts_map", with_sql(["viewer_events"], """
SELECT viewer_id, tag, count(*) AS n FROM (SELECT viewer_id, unnest(tags) AS tag FROM viewer_events) GROUP BY 1, 2"""))
def sf17(t: Tables):
    # Per-event map first, then counts are summed per (viewer, tag): no viewer's events are gathered in one row.
    per_event = t.viewer_events().select("viewer_id", F.explode(arrays.count_by("tags")).alias("tag", "c"))
    return per_event.groupBy("viewer_id", "tag").agg(F.sum("c").alias("n"))


@query("sf18_json_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def sf18(t: Tables):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
                                  F.get_json_object("props", "$.none").alias("missing"))


@query("sf18_nested_strings", r"""
SELECT c_custkey, list_filter([c_name, c_mktsegment || chr(10) || '"' || c_custkey || '\', 'x: y', c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'rich' END], lambda x: x IS NOT NULL) AS strings FROM customer""")
def sf18_nested(t: Tables):
    inner = F.struct(F.array(F.struct(F.concat(F.lit(" "), "c_mktsegment", F.lit('\n"'), F.col("c_custkey").cast("string"), F.lit("\\")).alias("note"), F.col("c_acctbal").alias("n"))).alias("list"),
                     F.struct(F.lit("x: y").alias('a "key":'), F.lit("  ").alias("blank"), F.struct(F.col("c_mktsegment").alias("deep")).alias("more")).alias("object"))
    payload = F.to_json(F.struct(F.col("c_name").alias("name"), inner.alias("inner"), F.when(F.col("c_acctbal") > 0, "rich").alias("tag"), F.lit(True).alias("flag")))
    return t.raw("customer").select("c_custkey", json.nested_strings(payload).alias("strings"))


@query("sf19_hash_keys", """
SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer""")
def sf19(t: Tables):
    return t.raw("customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha1("c_name").alias("s1"),
                                    F.sha2("c_name", 256).alias("s2"))


@query("sf19_condition_key", with_sql(["places"], """
SELECT query_id, sha1('{"skills":["' || lower(skills[1]) || '"],"locations":[' || array_to_string(list_transform(list_sort(list_transform(locations, lambda x: lower(x))), lambda x: '"' || x || '"'), ',')
  || '],"experience":"' || coalesce(experience, '') || '","role":"' || role || '","sourceBias":"' || coalesce(source_bias, '') || '","mustHave":['
  || array_to_string(list_transform(list_sort(list_transform(must_have, lambda x: lower(x))), lambda x: '"' || x || '"'), ',') || '],"niceToHave":['
  || array_to_string(list_transform(list_sort(nice_to_have), lambda x: '"' || x || '"'), ',') || '],"exclude":["no"],"preferFresh":' || prefer_fresh || '}') AS cache_key
FROM cond""", COND_SQL))
def sf19_key(t: Tables):
    c = normalize.normalize_conditions(conditions(t))
    return c.select("query_id", similarity.query_cache_key(
        "skills", "locations", "experience", "role", "source_bias", "must_have", "nice_to_have", "exclude",
        "prefer_fresh").alias("cache_key"))


@query("sf20_match_strength", with_sql(["persons"], """
SELECT person_id, CASE WHEN headline IN ('MACHINERY') THEN 'strong' WHEN headline = 'BUILDING' AND confidence >= 0.55 THEN 'strong' WHEN headline = 'BUILDING' THEN 'medium'
  WHEN headline = 'FURNITURE' AND confidence >= 0.45 THEN 'medium' WHEN headline = 'HOUSEHOLD' AND confidence >= 0.7 THEN 'medium' ELSE 'weak' END AS strength FROM persons"""))
def sf20(t: Tables):
    h = F.col("headline")
    reasons = (F.when(h == "MACHINERY", F.array(F.lit("技术命中：x"), F.lit("role match: y")))
               .when(h == "BUILDING", F.array(F.lit("strong keyword overlap"), F.lit("fallback")))
               .when(h == "FURNITURE", F.array(F.lit("地点命中：x"), F.lit("近期活跃：y")))
               .when(h == "HOUSEHOLD", F.array(F.lit("other"))).otherwise(F.array().cast("array<string>")))
    return t.persons().select("person_id", similarity.match_strength("confidence", reasons).alias("strength"))


@query("sf21_pair_scores", with_sql(["profiles"], """
SELECT a.ordinal, CASE WHEN a.display_name = b.display_name THEN 0.5 ELSE 0.0 END::DOUBLE AS name_score,
  CASE WHEN a.location = b.location THEN 0.3 WHEN split_part(a.location, ' / ', 1) = split_part(b.location, ' / ', 1) THEN CASE WHEN contains(a.location, 'MIDDLE EAST') THEN 0.2 ELSE 0.1 END ELSE 0.0 END::DOUBLE AS location_score,
  CASE WHEN contains(b.bio, a.company || '.') THEN 0.2 WHEN a.headline = 'engineer' AND b.headline = 'engineer' THEN 0.1 ELSE 0.0 END::DOUBLE AS company_score
FROM profiles a JOIN profiles b ON a.ordinal = b.ordinal AND a.source = 'bonjour' AND b.source = 'github'"""))
def sf21(t: Tables):
    p = t.profiles()
    a, b = p.filter("source = 'bonjour'").alias("a"), p.filter("source = 'github'").alias("b")
    def words(x):
        return F.lower(F.concat_ws(" ", F.coalesce(F.col(f"{x}.headline"), F.lit("")), F.coalesce(F.col(f"{x}.bio"), F.lit(""))))
    def org(x):
        return F.array(F.concat(F.col(f"{x}.company"), F.lit(".")))
    return a.join(b, F.col("a.ordinal") == F.col("b.ordinal")).select(
        "a.ordinal", similarity.name_score("a.display_name", "b.display_name").alias("name_score"),
        similarity.location_score("a.location", "b.location").alias("location_score"),
        similarity.company_score(words("a"), org("a"), words("b"), org("b")).alias("company_score"))
