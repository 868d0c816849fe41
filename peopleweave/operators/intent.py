"""Query understanding on a table of queries (one row per query)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.arrays import expand_family, or_empty, single, unique_lower
from ..functions.text import (blank_to_null, captured, contains_any, normalize_search_text, quoted_terms, trim_ws,
                              vocabulary_hits, word_hits)
from .normalize import normalize_conditions

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def first_hit(text: Column, words) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def infer_source(text: Column) -> Column:
    explicit = first_hit(text, [V.CODE_SOURCE, V.PROFILE_SOURCE])
    return F.coalesce(explicit, F.when(contains_any(text, V.OPEN_SOURCE_TERMS), F.lit(V.CODE_SOURCE)))


def tag_intents(queries: DataFrame, roles=V.ROLE_HINTS, skills=V.SKILL_HINTS, universities=V.UNIVERSITY_HINTS,
                places=V.PLACE_HINTS, levels=V.EXPERIENCE_HINTS) -> DataFrame:
    """Dictionary and pattern tagging of ``raw_query``; all vocabularies are parameters."""
    q = queries.withColumn("_t", F.lower("raw_query"))
    t = F.col("_t")
    school = vocabulary_hits(t, universities)
    must = F.array_distinct(F.concat(quoted_terms(F.col("raw_query")), captured(t, V.MUST_HAVE_PATTERNS), school))
    city = F.when(F.size(school) > 0, F.array(F.lit(V.UNIVERSITY_CITY))).otherwise(none())
    found = F.regexp_extract_all(t, F.lit("(" + "|".join(places) + ")"), F.lit(1))
    return q.select(
        *queries.columns, vocabulary_hits(t, roles).alias("roles"), vocabulary_hits(t, skills).alias("skills"),
        F.array_distinct(F.concat(city, found)).alias("locations"), first_hit(t, levels).alias("experience_level"),
        infer_source(t).alias("source_bias"), must.alias("must_haves"),
        F.array_distinct(captured(t, V.NICE_TO_HAVE_PATTERNS)).alias("nice_to_haves"))


def is_weak(term: Column) -> Column:
    return term.rlike("(?i)" + "|".join(V.WEAK_MUST_HAVE))


def merge_external(tagged: DataFrame, external: DataFrame) -> DataFrame:
    """Union of a model's intent (columns prefixed ``ext_``) with the tagged one; weak must-haves become nice."""
    j = tagged.join(external, "query_id", "left")
    must = unique_lower("ext_must_haves", "must_haves")
    weak, strong = F.filter(must, is_weak), F.filter(must, lambda x: ~is_weak(x))
    named = F.lower("ext_source_bias")
    merged = {
        "roles": unique_lower("ext_roles", "roles"), "skills": unique_lower("ext_skills", "skills"),
        "locations": unique_lower("ext_locations", "locations"),
        "experience_level": F.coalesce(F.lower("ext_experience_level"), F.col("experience_level")),
        "source_bias": F.coalesce(F.when(named.isin(V.CODE_SOURCE, V.PROFILE_SOURCE), named), F.col("source_bias")),
        "must_haves": strong, "nice_to_haves": F.array_distinct(F.concat(unique_lower("ext_nice_to_haves", "nice_to_haves"), weak))}
    return j.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in tagged.columns])


def merge_conditions(tagged: DataFrame, conditions: DataFrame) -> DataFrame:
    """Explicit conditions added to the intent: role and skills also become must-haves."""
    c = conditions.select("query_id", *[F.col(n).alias(f"c_{n}") for n in (
        "role", "skills", "locations", "experience", "source_bias", "must_have", "nice_to_have")])
    j = tagged.join(c, "query_id", "left")
    role = single("c_role")
    merged = {
        "roles": unique_lower("roles", role), "skills": unique_lower("skills", "c_skills"),
        "locations": unique_lower("locations", "c_locations"),
        "experience_level": F.coalesce(F.col("experience_level"), F.lower("c_experience")),
        "source_bias": F.coalesce("c_source_bias", "source_bias"),
        "must_haves": unique_lower("must_haves", role, "c_skills", "c_must_have"),
        "nice_to_haves": unique_lower("nice_to_haves", "c_nice_to_have")}
    return j.select(*[merged[n].alias(n) if n in merged else F.col(n) for n in tagged.columns])


def keyword_query(roles_families=V.ROLE_FAMILIES, skill_families=V.SKILL_FAMILIES) -> Column:
    parts = F.concat(F.array("raw_query"), expand_family("roles", roles_families), expand_family("skills", skill_families),
                     or_empty("must_haves"), or_empty("nice_to_haves"))
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda p: normalize_search_text(p)),
                                                  lambda p: p != "")), " ")


def resolve_anchors(queries: DataFrame, pools: DataFrame) -> DataFrame:
    """Anchor of each query -> person: by id, by 1-based shortlist position, by unique exact name.

    queries: (query_id, anchor_person, anchor_index, anchor_name); pools: (query_id, pool, position, person_id, name),
    pool 'shortlist' gives positions, every pool gives names.
    """
    by_place = pools.filter("pool = 'shortlist'").select("query_id", F.col("position").alias("anchor_index"),
                                                         F.col("person_id").alias("_placed"))
    names = pools.groupBy("query_id", F.lower(trim_ws("name")).alias("_name")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("person_id").alias("_named"))
    j = (queries.withColumn("_name", F.lower(blank_to_null("anchor_name"))).join(by_place, ["query_id", "anchor_index"], "left")
         .join(names, ["query_id", "_name"], "left"))
    by_id = blank_to_null("anchor_person")
    wants = by_id.isNotNull() | F.col("anchor_index").isNotNull() | F.col("_name").isNotNull()
    status = (F.when(~wants, None).when(by_id.isNotNull() | F.col("_placed").isNotNull(), "resolved")
              .when(F.col("_name").isNotNull() & (F.col("_n") == 1), "resolved")
              .when(F.col("_name").isNotNull() & (F.col("_n") > 1), "ambiguous").otherwise("not_found"))
    person = F.coalesce(by_id, F.col("_placed").cast("string"),
                        F.when(F.col("_n") == 1, F.col("_named").cast("string")))
    return j.select("query_id", status.alias("status"), F.when(status == "resolved", person).alias("resolved_person"))


def extract_conditions(texts: DataFrame, skills=V.REFINE_SKILLS, places=V.REFINE_PLACES, roles=V.REFINE_ROLES) -> DataFrame:
    """Conditions named in free refine text (column ``text``)."""
    t = texts.withColumn("_l", F.lower("text"))
    low, raw = F.col("_l"), F.col("text")
    school, student = raw.rlike(V.SCHOOL_PATTERN), raw.rlike(V.STUDENT_PATTERN)
    years = F.nullif(F.regexp_extract(raw, r"(\d+\s*年(?:以上)?)", 1), F.lit(""))
    senior = F.when(raw.contains("资深") | low.contains("senior"), F.lit("资深"))
    source = F.when(low.contains(V.PROFILE_SOURCE), V.PROFILE_SOURCE).when(low.contains(V.CODE_SOURCE), V.CODE_SOURCE)
    index = F.nullif(F.regexp_extract(raw, r"(?:像|参考|类似)\s*(\d+)\s*号", 1), F.lit("")).cast("int")

    def listed(value):
        return F.array_distinct(value)

    rows = t.select(
        *texts.columns, word_hits(low, skills).alias("skills"),
        F.array_compact(F.array(*[F.when(raw.contains(p) | low.contains(p), F.lit(p)) for p in places])).alias("locations"),
        F.coalesce(*[F.when(raw.contains(r) | low.contains(r), F.lit(r)) for r in roles]).alias("role"),
        F.coalesce(years, senior).alias("experience"), source.alias("source_bias"),
        listed(F.concat(F.when(school, F.array(F.lit("zhejiang university"))).otherwise(none()),
                        captured(low, V.REFINE_MUST))).alias("must_have"),
        listed(F.concat(F.when(student, F.array(F.lit("本科生"))).otherwise(none()),
                        captured(low, V.REFINE_NICE))).alias("nice_to_have"),
        listed(captured(low, V.REFINE_EXCLUDE)).alias("exclude"), low.rlike(V.REFINE_FRESH).alias("prefer_fresh"),
        index.alias("anchor_index"), F.lit(None).cast("int").alias("limit"))
    return normalize_conditions(rows)


# Words that name an axis in a relax instruction.
RELAX_WORDS = "放宽|宽一点|不限|都可以|随便|几个人选|先给我看看"
AXIS_WORDS = {"locations": "地点|城市|remote|远程|杭州|上海|北京|深圳|广州", "experience": "经验|年限|资深|senior|junior",
              "skills": "技术|技术栈|关键词|python|java|go|rust|vllm|cuda|llm|rag",
              "role": "角色|后端|前端|工程师|researcher|engineer|backend|frontend",
              "broad": "放宽要求|给我提供几个|先给我几个", "fresh": "最近|活跃|最新|fresh|recent"}
LISTS = ["skills", "locations", "must_have", "nice_to_have", "exclude"]


def revise_conditions(current: DataFrame, instructions: DataFrame, **vocabularies) -> DataFrame:
    """Apply one instruction per query: tighten (union), relax (replace only named axes) or edit (replace).

    instructions: (query_id, text, mode). The result has the columns of ``current``.
    """
    new = extract_conditions(instructions, **vocabularies)
    names = [*LISTS, "role", "experience", "source_bias", "prefer_fresh", "anchor_index"]
    new = new.select("query_id", "mode", "text", *[F.col(n).alias(f"n_{n}") for n in names])
    j = current.join(new, "query_id")
    text, low = F.col("text"), F.lower("text")
    relax = (F.col("mode") == "relax") | ((F.col("mode") == "edit") & text.rlike(RELAX_WORDS))
    tighten = F.col("mode") == "tighten"

    def union(n):
        return F.array_distinct(F.concat(or_empty(n), or_empty(f"n_{n}")))

    def some(n):
        return F.size(f"n_{n}") > 0

    def replaced(n):
        return F.when(some(n), F.col(f"n_{n}")).otherwise(or_empty(n))

    def axis(n, where):
        return where.rlike(AXIS_WORDS[n])

    out = {}
    for n, where in (("skills", low), ("locations", text)):
        out[n] = F.when(tighten, union(n)).when(relax, F.when(axis(n, where), F.col(f"n_{n}")).otherwise(or_empty(n))
                                                ).otherwise(replaced(n))
    for n in ("must_have", "nice_to_have", "exclude"):
        out[n] = F.when(some(n), union(n)).otherwise(or_empty(n))
    kept_experience = F.when(axis("experience", text), F.col("n_experience")).otherwise(F.col("experience"))
    out["experience"] = F.when(relax, F.when(axis("broad", text), F.lit(None).cast("string")).otherwise(kept_experience)
                               ).otherwise(F.coalesce("n_experience", "experience"))
    out["role"] = F.when(relax, F.when(axis("role", text), F.col("n_role")).otherwise(F.col("role"))).otherwise(
        F.coalesce("n_role", "role"))
    named = F.when(low.contains(V.CODE_SOURCE), V.CODE_SOURCE).when(low.contains(V.PROFILE_SOURCE), V.PROFILE_SOURCE)
    out["source_bias"] = F.when(relax, F.coalesce(named, F.col("source_bias"))).otherwise(
        F.coalesce("n_source_bias", named, "source_bias"))
    out["prefer_fresh"] = F.when(relax, F.when(axis("fresh", low), F.col("n_prefer_fresh")).otherwise(
        F.col("prefer_fresh"))).otherwise(F.col("prefer_fresh") | F.col("n_prefer_fresh"))
    if "anchor_index" in current.columns:
        out["anchor_index"] = F.coalesce("n_anchor_index", "anchor_index")
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in current.columns])

