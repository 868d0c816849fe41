"""Evidence extraction: profile rows to typed evidence rows with a stable SHA-256 hash."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import blank_to_null, role_signals, trim_ws
from .common import best_row
from .normalize import RAW_CODE_SCHEMA, RAW_PROFILE_SCHEMA

COLUMNS = ["source", "source_profile_id", "evidence_type", "title", "description", "url", "occurred_at", "metadata",
           "evidence_hash"]
META = "map<string,string>"


def _hash(*parts) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("undefined")) if isinstance(p, Column) else F.lit(p)
                                     for p in parts]), 256)


def _meta(**values: Column) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _rows(df: DataFrame, keep, **values: Column) -> DataFrame:
    defaults = {"title": F.lit(None).cast("string"), "description": F.lit(None).cast("string"),
                "url": F.lit(None).cast("string"), "occurred_at": F.lit(None).cast("timestamp"),
                "metadata": F.create_map().cast(META)}
    return df.select(*keep, *[{**defaults, **values}[c].alias(c) for c in COLUMNS])


def parsed_profiles(raw: DataFrame) -> DataFrame:
    """The payload as ``p``; its id may be called ``_id`` or ``profile_id``."""
    parsed = raw.withColumn("p", F.from_json("raw_payload", RAW_PROFILE_SCHEMA))
    return parsed.withColumn("p", F.col("p").withField("_id", F.coalesce("p._id", F.get_json_object("raw_payload", "$.profile_id"))))


def projects(parsed: DataFrame, keep=()) -> DataFrame:
    rows = parsed.select(*keep, "p", F.explode("p.creations").alias("c"))
    url, title = F.nullif(F.col("c.url"), F.lit("")), F.nullif(F.col("c.title"), F.lit(""))
    rows = rows.filter(url.isNotNull() | title.isNotNull())
    return _rows(rows, keep, source=F.lit(V.PROFILE_SOURCE), source_profile_id=F.col("p._id"),
                 evidence_type=F.lit("project"), title=blank_to_null("c.title"), description=blank_to_null("c.description"),
                 url=blank_to_null("c.url"), metadata=_meta(imageUrl=F.col("c.image")),
                 evidence_hash=_hash(V.PROFILE_SOURCE, "project", F.col("p._id"), F.coalesce(url, title)))


def socials(parsed: DataFrame, keep=()) -> DataFrame:
    rows = parsed.select(*keep, "p", F.explode("p.socials").alias("s")).filter(blank_to_null("s.content").isNotNull())
    return _rows(rows, keep, source=F.lit(V.PROFILE_SOURCE), source_profile_id=F.col("p._id"),
                 evidence_type=F.lit("social"), title=F.col("s.type"), description=trim_ws("s.content"),
                 url=F.when(F.col("s.content").startswith("http"), trim_ws("s.content")),
                 metadata=_meta(socialType=F.lower("s.type")),
                 evidence_hash=_hash(V.PROFILE_SOURCE, "social", F.col("p._id"), F.col("s.type"), F.col("s.content")))


def job_signals(posts: DataFrame, keep=()) -> DataFrame:
    """posts: (source_profile_id, post_id, type, content, link, create_time, categories)."""
    pieces = F.concat(F.array(F.lower(F.coalesce("type", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))),
                      F.transform(F.coalesce("categories", F.array().cast("array<string>")), F.lower))
    haystack = F.array_join(pieces, "\n")
    found = F.coalesce(*[F.when(haystack.contains(s), F.lit(s)) for s in V.JOB_SIGNALS])
    rows = posts.withColumn("signal", found).filter(F.col("signal").isNotNull())
    return _rows(rows, keep, source=F.lit(V.PROFILE_SOURCE), source_profile_id=F.col("source_profile_id"),
                 evidence_type=F.lit("job_signal"), title=F.coalesce("type", F.lit("Job Signal")),
                 description=blank_to_null("content"), url=F.col("link"), occurred_at=F.col("create_time").cast("timestamp"),
                 metadata=_meta(postId=F.col("post_id"), categories=F.to_json("categories"), signalType=F.when(
                     F.col("signal").contains("hiring"), "hiring").otherwise("open_to_work")),
                 evidence_hash=_hash(V.PROFILE_SOURCE, "job_signal", F.col("source_profile_id"),
                                     F.col("post_id").cast("string")))


def profile_fields(parsed: DataFrame, keep=()) -> DataFrame:
    named = F.array(*[F.struct(F.lit(title).alias("title"), F.col(f"p.basicInfo.{name}").alias("value"))
                      for title, name in (("Current Doing", "current_doing"), ("Role", "role"), ("Skill", "skill"))])
    rows = parsed.select(*keep, "p", F.explode(named).alias("f")).filter(blank_to_null("f.value").isNotNull())
    signals = role_signals("f.value")
    return _rows(rows, keep, source=F.lit(V.PROFILE_SOURCE), source_profile_id=F.col("p._id"),
                 evidence_type=F.lit("profile_field"), title=F.col("f.title"), description=trim_ws("f.value"),
                 metadata=_meta(field=F.regexp_replace(F.lower("f.title"), r"\s+", "_"),
                                roleSignals=F.nullif(F.to_json(signals), F.lit("[]"))),
                 evidence_hash=_hash(V.PROFILE_SOURCE, "profile_field", F.col("p._id"), F.col("f.title"), F.col("f.value")))


REPO = ("array<struct<id:long,name:string,full_name:string,html_url:string,description:string,stargazers_count:long,"
        "forks_count:long,language:string,created_at:string,updated_at:string,pushed_at:string,owner:struct<login:string>>>")


def repositories(code: DataFrame, keep=()) -> DataFrame:
    """code: (profile_id, login, repositories array) -> rows of repositories the profile owns."""
    rows = code.select(*keep, "profile_id", "login", F.explode("repositories").alias("r")).filter(
        F.lower("r.owner.login") == F.lower("login"))
    r = F.col("r")
    return _rows(rows, keep, source=F.lit(V.CODE_SOURCE), source_profile_id=F.col("profile_id").cast("string"),
                 evidence_type=F.lit("repository"), title=r["name"], description=blank_to_null(r["description"]),
                 url=r["html_url"], metadata=_meta(
                     fullName=r["full_name"], stars=r["stargazers_count"], forks=r["forks_count"], language=r["language"],
                     createdAt=r["created_at"], updatedAt=r["updated_at"], pushedAt=r["pushed_at"]),
                 evidence_hash=_hash(V.CODE_SOURCE, "repository", F.col("profile_id").cast("string"), r["id"].cast("string")))


def code_profile_fields(raw: DataFrame, keep=()) -> DataFrame:
    p = F.from_json("raw_payload", RAW_CODE_SCHEMA)
    df = raw.withColumn("p", p)
    fields = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("title"), F.lit(n).alias("field"), F.col(f"p.{n}").alias("value"))
                       for k, t, n in (("profile_field", "Company", "company"), ("profile_field", "Location", "location"),
                                       ("profile_field", "Bio", "bio"), ("social", "Website", "blog"))])
    rows = df.select(*keep, "p", F.explode(fields).alias("f")).filter(blank_to_null("f.value").isNotNull())
    pid = F.col("p.id").cast("string")
    return _rows(rows, keep, source=F.lit(V.CODE_SOURCE), source_profile_id=pid, evidence_type=F.col("f.kind"),
                 title=F.col("f.title"), description=trim_ws("f.value"),
                 url=F.when(F.col("f.kind") == "social", trim_ws("f.value")), metadata=_meta(field=F.col("f.field")),
                 evidence_hash=_hash(V.CODE_SOURCE, F.col("f.kind"), pid, F.col("f.field"), F.col("f.value")))


def web_summaries(profiles: DataFrame, keep=()) -> DataFrame:
    headline, bio = F.nullif(F.col("headline"), F.lit("")), F.nullif(F.col("bio"), F.lit(""))
    rows = profiles.filter(headline.isNotNull() | bio.isNotNull())
    return _rows(rows, keep, source=F.lit(V.WEB_SOURCE), source_profile_id=F.coalesce("source_profile_id", "handle"),
                 evidence_type=F.lit("summary"), title=F.coalesce(headline, F.lit("Personal Website Summary")),
                 description=F.col("bio"), url=F.col("url"), evidence_hash=_hash(V.WEB_SOURCE, "summary", F.col("handle"), F.col("url")))


def code_payloads(raw: DataFrame) -> DataFrame:
    """Code-source rows with ``raw_payload`` (the profile object), ``login`` and ``repositories``.

    A stored payload wraps the profile as {profile, repositories}; a bare profile has no repositories.
    """
    profile = F.coalesce(F.get_json_object("raw_payload", "$.profile"), F.col("raw_payload"))
    rows = raw.withColumns({"repositories": F.from_json(F.get_json_object("raw_payload", "$.repositories"), REPO), "raw_payload": profile})
    return rows.withColumns({"code_id": F.get_json_object("raw_payload", "$.id"), "login": F.get_json_object("raw_payload", "$.login")})


def extract_all(persons: DataFrame, identities: DataFrame, stored: DataFrame, posts: DataFrame | None = None):
    """Every active person's profiles -> (new evidence rows, error rows).

    stored: (profile_id, source, raw_payload, headline, bio, handle, url, source_profile_id). Profiles are
    dispatched by source; a payload that does not parse becomes an error row and stops nothing.
    posts: community posts as ``job_signals`` takes them, of the profiles with their source_profile_id.
    """
    active = persons.filter("status = 'active'").select("person_id")
    linked = active.join(identities.select("person_id", "profile_id"), "person_id").join(stored, "profile_id")
    a = parsed_profiles(linked.filter(F.col("source") == V.PROFILE_SOURCE))
    a_ok = a.filter(F.col("p._id").isNotNull())
    b = code_payloads(linked.filter(F.col("source") == V.CODE_SOURCE))
    b_ok = b.filter("code_id IS NOT NULL")
    w = linked.filter(F.col("source") == V.WEB_SOURCE)
    keep = ["person_id", "profile_id"]
    items = (projects(a_ok, keep).unionByName(socials(a_ok, keep)).unionByName(profile_fields(a_ok, keep))
             .unionByName(code_profile_fields(b_ok, keep)).unionByName(web_summaries(w, keep))
             .unionByName(repositories(b_ok.select("person_id", F.col("profile_id").alias("stored_id"), F.col("code_id").alias("profile_id"), "login", "repositories"),
                                       ["person_id", "stored_id"]).withColumnRenamed("stored_id", "profile_id")))
    if posts is not None:
        own = a_ok.select(*keep, F.col("p._id").alias("source_profile_id")).join(posts, "source_profile_id")
        items = items.unionByName(job_signals(own, keep))
    errors = (a.filter(F.col("p._id").isNull()).select(*keep, F.lit("profile payload missing id").alias("message"))
              .unionByName(b.filter("code_id IS NULL").select(*keep, F.lit("code payload missing profile object").alias("message"))))
    unique = best_row(items, ["person_id", "source", "evidence_hash"], F.struct("profile_id", "evidence_type"), maximum=False)
    return unique, errors


def page_connections(pages: DataFrame) -> DataFrame:
    """Links of crawled pages (person_id, url, html) as 'discovered_connection' rows, one per (person, link).

    A link that starts with '/' is completed with the origin of its page.
    """
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a[^>]*href="((?:https?:/)?/[^"#\s]+)'), F.lit(1))
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    rows = pages.select("person_id", origin.alias("origin"), F.explode(F.array_distinct(links)).alias("link"))
    rows = rows.select("person_id", F.when(F.col("link").startswith("/"), F.concat("origin", "link")).otherwise(F.col("link")).alias("url")).distinct()
    return rows.select("person_id", F.lit(V.WEB_SOURCE).alias("source"), F.lit("social").alias("evidence_type"),
                       F.lit("discovered_connection").alias("title"), "url", F.sha2("url", 256).alias("evidence_hash"))
