"""Explanations, condition audits, badges, warnings and result cards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.arrays import or_empty
from ..functions.dates import raw_age_days, relative_label
from ..functions.similarity import match_strength, percent
from ..functions.text import blank_to_null, context_term_match, truncate_plain, trim_ws, url_key
from .common import best_row
from .windows import preview_evidence, weight_of, work_links


def none() -> Column:
    return F.array().cast("array<string>")


def source_label(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.SOURCE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), source)


def evidence_headline(kind: Column, title: Column, description: Column) -> Column:
    t, d = blank_to_null(title), blank_to_null(description)
    both = (kind == "profile_field") & t.isNotNull() & d.isNotNull()
    return truncate_plain(F.when(both, F.concat(t, F.lit(": "), d)).otherwise(F.coalesce(t, d, F.lit("未命名证据"))), 54)


def search_context(name="name", headline="headline", location="location", summary="summary", doc_text="doc_text",
                   roles="facet_role", tags="facet_tags", evidence_text="evidence_text") -> Column:
    values = [F.coalesce(F.col(c), F.lit("")) for c in (name, headline, location, summary, doc_text)]
    return F.lower(F.concat_ws(" ", *values, F.array_join(or_empty(roles), " "), F.array_join(or_empty(tags), " "),
                               F.coalesce(F.col(evidence_text), F.lit(""))))


def matched(terms: Column, context: Column) -> Column:
    return F.filter(terms, lambda t: context_term_match(t, context))


def matched_locations(locations: Column, location: Column, facets: Column) -> Column:
    values = F.transform(F.concat(F.array(F.coalesce(location, F.lit(""))), or_empty(facets)), F.lower)
    return F.filter(locations, lambda loc: F.exists(values, lambda v: F.contains(v, F.lower(loc)) | F.contains(F.lower(loc), v)))


def translated_reason(reason: Column) -> Column:
    """Retrieval reason in the wording of explanations; null for reasons that are not shown."""
    r = trim_ws(reason)

    def after(prefix):
        return F.nullif(trim_ws(F.regexp_extract(r, f"(?i)^{prefix}:\\s*(.+)$", 1)), F.lit(""))

    role, skill, must, project = after("role match"), after("skill evidence"), after("must-have matched"), after("project")
    return (F.when(role.isNotNull(), F.concat(F.lit("检索角色命中："), role))
            .when(skill.isNotNull(), F.concat(F.lit("检索技能命中："), skill))
            .when(must.isNotNull(), F.concat(F.lit("检索必须项命中："), must))
            .when(project.isNotNull(), F.concat(F.lit("相关项目："), truncate_plain(project, 36)))
            .when(r == "strong semantic similarity", "语义相似度高").when(r == "strong keyword overlap", "关键词重合度高"))


def relevant_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """One evidence item per (query, person) worth quoting.

    pairs: (query_id, person_id, skills). The first item mentioning a wanted skill (any project or
    repository when no skill is asked), else the first project, repository or job. Only the best row is
    kept by a min_by aggregation.
    """
    kind = F.col("evidence_type")
    e = evidence.select("person_id", "evidence_id", "evidence_type", "title", "description")
    e = e.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != ""))
    j = pairs.join(e, "person_id")
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    strong = F.when(F.size("skills") > 0, F.exists("skills", lambda s: context_term_match(s, text))).otherwise(
        kind.isin("project", "repository"))
    level = F.when(strong, 0).when(kind.isin("project", "repository", "experience"), 1)
    j = j.withColumn("level", level).filter("level IS NOT NULL")
    best = j.groupBy("query_id", "person_id").agg(F.min_by(F.struct("evidence_type", "title", "description"),
                                                           F.struct("level", "evidence_id")).alias("e"))
    return best.select("query_id", "person_id", F.concat(F.lit("相关证据："), evidence_headline(
        F.col("e.evidence_type"), F.col("e.title"), F.col("e.description"))).alias("evidence_reason"))


def explain(candidates: DataFrame, now) -> DataFrame:
    """Ordered distinct reasons and their summary.

    candidates carry the condition columns (skills, locations, must_have, role, experience, source_bias,
    prefer_fresh), the person and document columns, sources (labels), reference_date, experience_matched,
    match_reasons, evidence_reason and score.
    """
    c = candidates.withColumn("_context", search_context())
    ctx = F.col("_context")

    def listed(prefix, items, n):
        return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(items, 1, n), " / ")))

    c = c.withColumns({"_loc": matched_locations(or_empty("locations"), F.col("location"), F.col("facet_location")),
                       "_skill": matched(or_empty("skills"), ctx), "_must": matched(or_empty("must_have"), ctx)})
    label = source_label(F.col("source_bias"))
    own = F.array_compact(F.array(
        listed("地点命中：", F.col("_loc"), 2),
        F.when(F.col("role").isNotNull() & context_term_match(F.coalesce("role", F.lit("")), ctx), F.concat(F.lit("角色贴合："), F.col("role"))),
        listed("技术命中：", F.col("_skill"), 3), listed("必须项满足：", F.col("_must"), 2),
        F.when(F.col("experience").isNotNull() & F.col("experience_matched"), F.concat(F.lit("经验层级贴合："), F.col("experience"))),
        F.when(F.col("source_bias").isNotNull() & F.array_contains("sources", label), F.concat(F.lit("来源过滤命中："), label)),
        F.when(F.col("prefer_fresh") & F.col("reference_date").isNotNull(), F.concat(F.lit("近期活跃："), relative_label("reference_date", now)))))
    retrieved = F.array_compact(F.transform(or_empty("match_reasons"), translated_reason))
    all_reasons = F.array_distinct(F.concat(own, retrieved, F.array_compact(F.array("evidence_reason"))))
    c = c.withColumn("_r", all_reasons)
    backup = F.array(F.coalesce(F.concat(F.lit("综合相关度 "), F.round(percent("score"), 0).cast("long").cast("string"), F.lit("%")),
                                F.lit("与当前条件整体相关度较高")))
    c = c.withColumn("reasons", F.when(F.size("_r") > 0, F.col("_r")).otherwise(backup))
    return c.withColumn("summary_text", F.array_join(F.slice("reasons", 1, 2), "，")).drop("_context", "_loc", "_skill", "_must", "_r")


def audit_conditions(candidates: DataFrame, now) -> DataFrame:
    """(query_id, person_id, label, status) for every condition: met, unmet or unknown.

    Needs the columns of ``explain`` plus has_role_evidence.
    """
    c = candidates.withColumn("_context", search_context())
    ctx = F.col("_context")

    def item(label, status):
        return F.struct((label if isinstance(label, Column) else F.lit(label)).alias("label"), status.alias("status"))

    def when(condition, entry):
        return F.when(condition, F.array(entry))

    places = matched_locations(or_empty("locations"), F.col("location"), F.col("facet_location"))
    known_place = (F.coalesce("location", F.lit("")) != "") | (F.size(or_empty("facet_location")) > 0)
    known_role = (F.coalesce("headline", F.lit("")) != "") | (F.coalesce("summary", F.lit("")) != "") | (
        F.size(or_empty("facet_role")) > 0) | F.col("has_role_evidence")
    label = source_label(F.col("source_bias"))
    known_source = F.exists("sources", lambda s: (s != "") & (s != "Unknown"))
    age = raw_age_days("reference_date", now)

    def per_term(prefix, name):
        return F.transform(or_empty(name), lambda t: item(F.concat(F.lit(prefix), t), F.when(context_term_match(t, ctx), "met").otherwise("unknown")))

    entry = "array<struct<label:string,status:string>>"
    blocks = [
        when(F.size(or_empty("locations")) > 0, item("地点", F.when(F.size(places) > 0, "met").when(known_place, "unmet").otherwise("unknown"))),
        when(F.col("role").isNotNull(), item("角色", F.when(context_term_match(F.coalesce("role", F.lit("")), ctx), "met")
                                             .when(known_role, "unmet").otherwise("unknown"))),
        per_term("技能 ", "skills"), per_term("必须项 ", "must_have"),
        when(F.col("experience").isNotNull(), item("经验层级", F.when(F.col("experience_matched"), "met").otherwise("unknown"))),
        when(F.col("source_bias").isNotNull(), item("来源过滤", F.when(F.array_contains("sources", label), "met")
                                                     .when(known_source, "unmet").otherwise("unknown"))),
        when(F.col("prefer_fresh"), item("近期活跃", F.when(age.isNull(), "unknown").when(age <= 90, "met").otherwise("unmet")))]
    every = F.flatten(F.array(*[F.coalesce(b, F.array().cast(entry)) for b in blocks]))
    return c.select("query_id", "person_id", F.posexplode(every).alias("position", "a")).select(
        "query_id", "person_id", "position", "a.label", "a.status")


def primary_links(identities: DataFrame, profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Up to one link per source and two work links per person, distinct by URL key, first kept."""
    order = {V.PROFILE_SOURCE: 0, V.CODE_SOURCE: 1, V.WEB_SOURCE: 2}
    own = identities.select("person_id", "profile_id").join(profiles.select("profile_id", "source", "url"), "profile_id")
    own = own.groupBy("person_id", "source").agg(F.min_by("url", "profile_id").alias("url"))
    names = F.create_map(*[F.lit(x) for pair in {"bonjour": "Bonjour", "github": "GitHub", "web": "个人站点"}.items() for x in pair])
    a = own.select("person_id", weight_of(F.col("source"), order, 9).alias("seq"),
                   F.try_element_at(names, F.col("source")).alias("label"), trim_ws("url").alias("url"))
    w = work_links(evidence, 2)
    title = evidence_headline(F.col("evidence_type"), F.col("title"), F.col("description"))
    b = w.select("person_id", (F.col("rank") + 10).alias("seq"), F.when(title == "未命名证据", F.concat(F.lit("作品页 "), F.col("rank").cast("string")))
                 .otherwise(F.concat(F.lit("作品页："), truncate_plain(title, 24))).alias("label"), trim_ws("url").alias("url"))
    rows = a.unionByName(b).filter(F.coalesce("url", F.lit("")) != "").withColumn("url_key", url_key("url"))
    return best_row(rows, ["person_id", "url_key"], F.col("seq"), maximum=False)


def source_badges(docs: DataFrame, identities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct display labels per person; 'Unknown' when there is none."""
    from_docs = docs.select("person_id", F.explode("facet_source").alias("s")).select("person_id", source_label(F.col("s")).alias("label"))
    linked = identities.select("person_id", "profile_id").join(profiles.select("profile_id", "source"), "profile_id").select(
        "person_id", source_label(F.col("source")).alias("label"))
    found = from_docs.unionByName(linked).distinct().groupBy("person_id").agg(F.sort_array(F.collect_list("label")).alias("sources"))
    return docs.select("person_id").distinct().join(found, "person_id", "left").withColumn(
        "sources", F.coalesce("sources", F.array(F.lit("Unknown"))))


def result_warnings(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Warning and suggestion codes per query by its strongest match; no row needed means no warning."""
    level = F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "medium", 2).otherwise(1)
    top = results.groupBy("query_id").agg(F.max(level).alias("top"))
    j = queries.select("query_id").join(top, "query_id", "left")
    code = F.when(F.col("top").isNull(), "no_results").when(F.col("top") == 2, "no_strong_match_medium").when(
        F.col("top") == 1, "no_strong_match_weak")
    hints = (F.when(F.col("top").isNull(), F.array(F.lit("broaden_must_haves"), F.lit("broaden_query")))
             .when(F.col("top") == 2, F.array(F.lit("add_must_haves"), F.lit("broaden_sources")))
             .when(F.col("top") == 1, F.array(F.lit("clarify_role"), F.lit("clarify_skill"), F.lit("broaden_sources"))))
    return j.select("query_id", code.alias("warning"), hints.alias("suggestions"))


def result_cards(ranked: DataFrame, persons: DataFrame, evidence: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Cards of ranked results: shown persons only, strength, reasons and an evidence preview."""
    previews = preview_evidence(evidence.join(ranked.select("person_id").distinct(), "person_id", "left_semi"), 3)
    preview = previews.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", "evidence_type", "title", "url"))), lambda x: F.struct(x["evidence_type"], x["title"], x["url"])).alias("preview"))
    people = persons.filter("status <> 'hidden'").select("person_id", "name", "headline", "status")
    j = ranked.join(people, "person_id").join(preview, "person_id", "left")
    note = F.lit(None).cast("string")
    if notes is not None:
        j = j.join(notes.select("query_id", "person_id", "note"), ["query_id", "person_id"], "left")
        note = F.col("note")
    base = F.when(F.size("match_reasons") > 0, F.col("match_reasons")).otherwise(
        F.array(F.lit("matched by hybrid keyword and semantic retrieval")))
    return j.select("query_id", "rank", "person_id", "name", "headline", "status", F.col("final_score").alias("match_score"),
                    match_strength("final_score", "match_reasons").alias("strength"),
                    F.concat(base, F.when(note.isNotNull(), F.array(note)).otherwise(none())).alias("reasons"), "preview")


def query_word_reason(raw_query: Column, context: Column, location_text: Column) -> Column:
    """Fallback reason: a query word found in the location, else the first two found anywhere."""
    words = F.filter(F.split(raw_query, r"\s+"), lambda w: w != "")
    found = F.filter(words, lambda w: F.contains(F.lower(context), F.lower(w)))
    place = F.get(F.filter(found, lambda w: F.contains(F.lower(location_text), F.lower(w))), F.lit(0))
    return F.when(place.isNotNull(), F.concat(F.lit("地点命中："), place)).when(
        F.size(found) > 0, F.concat(F.lit("命中查询词："), F.array_join(F.slice(found, 1, 2), " / ")))

