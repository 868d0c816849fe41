"""Raw payload -> normalised profile, content hashes, payload repair, condition tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.arrays import dedupe_keep_first, keep_first, or_empty, single
from ..functions.text import (blank_to_null, code_handles, coerce_json, field_or_null, headline_chain, trim_ws,
                              url_first_segment)

RAW_PROFILE_SCHEMA = (
    "_id string, profile_link string, user_link string, name string, bio string, description string, avatar string, "
    "create_time string, update_time string, socials array<struct<type:string,content:string>>, "
    "creations array<struct<url:string,title:string,description:string,image:string>>, "
    "gridItems array<struct<content:struct<social:struct<type:string,content:string>>>>, "
    "basicInfo struct<region:struct<countryName:string,provinceName:string,cityName:string>,"
    "current_doing:string,role:string,skill:string>")
RAW_CODE_SCHEMA = (
    "id long, login string, html_url string, name string, company string, blog string, location string, bio string, "
    "avatar_url string, twitter_username string, public_repos long, followers long, created_at string, updated_at string")
ALIAS = "array<struct<type:string,value:string,confidence:double>>"
# Names of link types, handle patterns and skipped handles.
SOCIAL_TYPES = {"github": "github", "x": "x", "twitter": "x", "jike": "jike", "website": "website"}
TEXT_CODE_HANDLE = r"(?i)(?:github\.com/|@)([a-zA-Z0-9-]{1,39})"
TEXT_X_HANDLE = r"(?i)(?:x\.com/|twitter\.com/)([a-zA-Z0-9_]{1,15})"
SKIPPED_TEXT_HANDLES = ["浙大", "浙江大学", "ZJU"]


def _alias(kind: Column, value: Column, confidence: float) -> Column:
    return F.struct(kind.alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"))


def _link_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOCIAL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), F.lit("other"))


def first_aliases(aliases: Column) -> Column:
    """Keep the first alias of every (type, case-insensitive value)."""
    return keep_first(aliases, lambda a: F.concat_ws(":", a["type"], F.lower(a["value"])))


def profile_aliases(p: Column) -> Column:
    """Explicit links, links inside grid items, then handles in free text at confidence .8."""
    def explicit(items):
        known = F.filter(items, lambda s: s["type"].isNotNull() & blank_to_null(s["content"]).isNotNull())
        return F.transform(known, lambda s: _alias(_link_type(s["type"]), F.when(
            _link_type(s["type"]).isin("github", "x"), url_first_segment(trim_ws(s["content"])))
            .otherwise(trim_ws(s["content"])), 1.0))

    socials = F.coalesce(p["socials"], F.array().cast("array<struct<type:string,content:string>>"))
    grid = F.transform(F.coalesce(p["gridItems"], F.array().cast(
        "array<struct<content:struct<social:struct<type:string,content:string>>>>")), lambda g: g["content"]["social"])
    grid = F.transform(F.filter(grid, lambda s: blank_to_null(s["content"]).isNotNull()), lambda s: F.struct(
        F.coalesce(s["type"], F.lit("other")).alias("type"), s["content"].alias("content")))
    text = F.concat_ws(" ", *[F.coalesce(p[c], F.lit("")) for c in ("name", "bio", "description")])
    code = F.filter(F.regexp_extract_all(text, F.lit(TEXT_CODE_HANDLE), F.lit(1)),
                    lambda h: (F.length(h) > 2) & ~F.upper(h).isin(SKIPPED_TEXT_HANDLES))
    social_x = F.regexp_extract_all(text, F.lit(TEXT_X_HANDLE), F.lit(1))
    return first_aliases(F.concat(
        explicit(socials), explicit(grid), F.transform(code, lambda h: _alias(F.lit("github"), h, 0.8)),
        F.transform(social_x, lambda h: _alias(F.lit("x"), h, 0.8))))


def join_parts(*fields: Column) -> Column:
    return F.nullif(F.concat_ws("\n\n", *[field_or_null(f) for f in fields]), F.lit(""))


def normalize_profiles(raw: DataFrame) -> DataFrame:
    """Source A: raw_payload JSON -> flat normalised profile columns (other columns pass through)."""
    p = F.from_json("raw_payload", RAW_PROFILE_SCHEMA)
    df = raw.withColumn("_p", p)
    p, info = F.col("_p"), F.col("_p.basicInfo")
    handle = F.coalesce(F.ltrim(field_or_null(p["user_link"]), F.lit("/")), p["profile_link"])
    summary = join_parts(p["bio"], p["description"], info["current_doing"], info["role"], info["skill"])
    region = info["region"]
    # Long expressions used by several outputs become columns of their own, which Spark keeps as one projection.
    df = df.withColumns({"_summary": summary, "_handle": handle})
    summary, handle = F.col("_summary"), F.col("_handle")
    location = F.nullif(F.concat_ws(" / ", *[F.nullif(region[c], F.lit("")) for c in
                                             ("countryName", "provinceName", "cityName")]), F.lit(""))
    return df.select(
        *raw.columns, F.lit(V.PROFILE_SOURCE).alias("source"), field_or_null(p["_id"]).alias("source_profile_id"),
        handle.alias("handle"), F.concat(F.lit(V.PROFILE_URL_PREFIX), handle).alias("url"),
        field_or_null(p["name"]).alias("display_name"),
        headline_chain(info["role"], info["current_doing"], p["bio"], summary).alias("headline"),
        field_or_null(p["description"]).alias("bio"), summary.alias("summary"),
        field_or_null(p["avatar"]).alias("avatar"), location.alias("location"), profile_aliases(p).alias("aliases"),
        content_hash(p["_id"], p["profile_link"], p["user_link"], p["name"], p["bio"], p["description"],
                     p["update_time"], F.to_json(p["socials"]), F.to_json(p["creations"]), F.to_json(info))
        .alias("profile_hash"))


def normalize_code_profiles(raw: DataFrame) -> DataFrame:
    """Source B."""
    df = raw.withColumn("_p", F.from_json("raw_payload", RAW_CODE_SCHEMA))
    p = F.col("_p")
    given = [(F.lit("x"), p["twitter_username"], 1.0), (F.lit("website"), p["blog"], 1.0), (F.lit("other"), p["company"], 0.6)]
    aliases = F.array_compact(F.array(*[F.when(blank_to_null(v).isNotNull(), _alias(k, trim_ws(v), c))
                                        for k, v, c in given]))
    return df.select(
        *raw.columns, F.lit(V.CODE_SOURCE).alias("source"), p["id"].cast("string").alias("source_profile_id"),
        p["login"].alias("handle"), p["html_url"].alias("url"), field_or_null(p["name"]).alias("display_name"),
        field_or_null(p["bio"]).alias("headline"), field_or_null(p["bio"]).alias("bio"),
        join_parts(p["bio"], p["company"], p["location"]).alias("summary"),
        field_or_null(p["avatar_url"]).alias("avatar"), field_or_null(p["location"]).alias("location"),
        aliases.alias("aliases"),
        content_hash(p["login"], p["name"], p["bio"], p["location"], p["company"], p["blog"], p["twitter_username"],
                     p["public_repos"].cast("string"), p["updated_at"]).alias("profile_hash"))


# Extension point: source name -> function from raw rows to normalised rows.
NORMALISERS = {V.PROFILE_SOURCE: normalize_profiles, V.CODE_SOURCE: normalize_code_profiles}


def register_normaliser(source: str, fn) -> None:
    NORMALISERS[source] = fn


def renormalize(stored: DataFrame) -> DataFrame:
    """Re-run every registered normaliser over all stored raw payloads (full-table rewrite)."""
    parts = [fn(stored.filter(F.col("stored_source") == source)) for source, fn in NORMALISERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def content_hash(*fields: Column) -> Column:
    """SHA-256 over the chosen fields; a missing field differs from an empty one."""
    named = [F.coalesce(f, F.lit(None).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def payload_handles(raw: Column, normalized: Column, aliases: Column) -> Column:
    """Code-source handles found anywhere in both payloads plus explicit aliases of that type."""
    from ..functions.text import alias_handle
    named = F.transform(F.filter(aliases, lambda a: a["type"] == V.CODE_SOURCE), lambda a: alias_handle(a["value"]))
    return F.filter(F.array_distinct(F.concat(code_handles(normalized, raw), named)), lambda h: h != "")


def repair_payloads(profiles: DataFrame, columns=("raw_payload", "normalized_payload")) -> DataFrame:
    """Unwrap payloads stored as JSON strings. ``error`` names the first payload that is no object."""
    out = profiles
    error = F.lit(None).cast("string")
    flags = []
    for name in columns:
        broken = trim_ws(name).startswith('"')
        fixed = coerce_json(name)
        bad = broken & (fixed.isNull() | (fixed == "{}"))
        error = F.coalesce(error, F.when(bad, F.lit(f"{name} could not be coerced into an object.")))
        out = out.withColumn(f"{name}_repaired", broken & ~bad).withColumn(f"_{name}", F.when(broken & ~bad, fixed)
                                                                          .otherwise(F.col(name)))
        flags.append(name)
    out = out.withColumn("error", error)
    for name in flags:
        keep = F.col("error").isNotNull()
        out = (out.withColumn(name, F.when(keep, F.col(name)).otherwise(F.col(f"_{name}")))
               .withColumn(f"{name}_repaired", F.col(f"{name}_repaired") & ~keep).drop(f"_{name}"))
    return out


def repair_summary(repaired: DataFrame) -> DataFrame:
    raw, norm = F.col("raw_payload_repaired"), F.col("normalized_payload_repaired")
    return repaired.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(raw | norm).alias("updated"),
                        F.count_if(raw).alias("raw_repaired"), F.count_if(norm).alias("normalized_repaired"),
                        F.count_if(F.col("error").isNotNull()).alias("errors"))


# --- condition tables ---------------------------------------------------------------------
def normalize_conditions(conditions: DataFrame, default_limit: int = 10) -> DataFrame:
    """One row per query: school and student words move to must / nice, lists lose repeats."""
    def school(x):
        return F.lower(trim_ws(x)).isin(V.SCHOOL_ALIASES)

    lists = ["skills", "locations", "must_have", "nice_to_have"]
    everything = F.concat(*[or_empty(c) for c in lists], single("role"), single("experience"))
    education = F.exists(everything, lambda x: x.rlike(V.SCHOOL_PATTERN) | x.rlike(V.STUDENT_PATTERN))
    none = F.array().cast("array<string>")
    has_school = education & F.exists(everything, school)
    has_student = education & F.exists(everything, lambda x: F.lower(trim_ws(x)).isin(V.STUDENT_TERMS))

    def without_school(name):
        return F.when(education, F.filter(or_empty(name), lambda x: ~school(x))).otherwise(or_empty(name))

    role = F.when(education & F.lower(trim_ws("role")).isin(V.STUDENT_TERMS), F.lit("学生")).otherwise(F.col("role"))
    rest = [c for c in conditions.columns if c not in (*lists, "exclude", "role", "experience", "limit", "prefer_fresh")]
    return conditions.select(
        *rest, dedupe_keep_first(without_school("skills")).alias("skills"),
        dedupe_keep_first(without_school("locations")).alias("locations"),
        dedupe_keep_first(F.concat(or_empty("must_have"), F.when(has_school, F.array(F.lit("zhejiang university")))
                                   .otherwise(none))).alias("must_have"),
        dedupe_keep_first(F.concat(or_empty("nice_to_have"), F.when(has_student, F.array(F.lit("本科生")))
                                   .otherwise(none))).alias("nice_to_have"),
        dedupe_keep_first("exclude").alias("exclude"), blank_to_null(role).alias("role"),
        blank_to_null("experience").alias("experience"),
        F.coalesce("prefer_fresh", F.lit(False)).alias("prefer_fresh"),
        F.coalesce(F.nullif(F.col("limit"), F.lit(0)), F.lit(default_limit)).alias("limit"))


def effective_query(skills="skills", locations="locations", experience="experience", role="role",
                    source_bias="source_bias", must="must_have", nice="nice_to_have", exclude="exclude",
                    prefer_fresh="prefer_fresh", anchor_name=None, anchor_index=None) -> Column:
    """Search text of a condition row, with the spoken prefixes."""
    school = F.array(*[F.lit(v) for v in V.UNIVERSITY_FAMILIES[0]])
    expanded = F.flatten(F.transform(or_empty(must), lambda m: F.when(
        F.lower(m) == "zhejiang university", school).otherwise(F.array(m))))
    parts = F.concat(
        or_empty(skills), or_empty(locations), single(experience), single(role), single(source_bias),
        F.transform(expanded, lambda m: F.concat(F.lit("must have "), m)),
        F.transform(or_empty(nice), lambda m: F.concat(F.lit("prefer "), m)),
        F.transform(or_empty(exclude), lambda m: F.concat(F.lit("exclude "), m)),
        F.when(F.col(prefer_fresh), F.array(F.lit("prefer recent active profiles"))).otherwise(
            F.array().cast("array<string>")),
        single(F.concat(F.lit("similar to "), F.col(anchor_name)) if anchor_name else F.lit(None).cast("string")),
        single(F.concat(F.lit("similar to shortlist "), F.col(anchor_index).cast("string")) if anchor_index
               else F.lit(None).cast("string")))
    kept = F.filter(F.transform(parts, trim_ws), lambda x: (x != "") & ~F.lower(x).isin(V.SKIPPED_QUERY_VALUES))
    return F.array_join(kept, " ")


