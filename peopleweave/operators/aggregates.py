"""Aggregations. All are partial + final groupBys, so a hot key is combined map-side before the shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.dates import at, age_days, first_timestamp
from ..functions.text import blank_to_null, trim_ws
from ..session import cut_lineage
from .common import top_k

FEEDBACK_KINDS = ["interested", "not_interested", "contacted", "revisit"]
INTERACTION_KINDS = ["detail_view", "repeat_view", "evidence_expand", "dwell"]


def sorted_set(value) -> Column:
    return F.sort_array(F.collect_set(value))


def distinct_facts(df: DataFrame, keys, kinds: dict[str, Column]) -> DataFrame:
    """(keys, kind, value): the distinct non-null values of some string columns per key, in long form.

    Rows are made distinct by key, kind and value, first in every task and then over a hash of all three, so the values of a hot key are spread over all
    tasks and never meet in one row.
    """
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])).alias("f")
    return df.select(*keys, facts).select(*keys, "f.kind", "f.value").filter(F.col("value").isNotNull()).distinct()


def nested_facts(facts: DataFrame, keys, kinds) -> DataFrame:
    """Facts as one sorted array per kind. A key becomes one row, so this is for results whose sets are known to be small."""
    sets = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds]
    return facts.groupBy(*keys).agg(*sets)


def _with_sets(counts: DataFrame, facts: DataFrame, key: str, kinds) -> DataFrame:
    sets = nested_facts(facts, [key], kinds)
    joined = counts.join(sets, key, "left")
    return joined.select(*counts.columns, *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in kinds])


# --- coverage -----------------------------------------------------------------------------
def coverage_report(persons, docs, embeddings, identities, profiles, approximate: bool = False) -> DataFrame:
    """One row of totals and rounded percentages of active persons."""
    def distinct(c):
        return F.approx_count_distinct(c) if approximate else F.countDistinct(c)

    linked = identities.select("person_id", "profile_id").join(profiles.select("profile_id", "source"), "profile_id")
    per_person = linked.groupBy("person_id").agg(
        F.countDistinct("source").alias("n"), F.max(F.col("source") == V.PROFILE_SOURCE).alias("a"),
        F.max(F.col("source") == V.CODE_SOURCE).alias("b"))
    names = ["total", "active", "indexed", "embedded", "multi_source", "profile_covered", "code_covered"]

    def metrics(df, **values):
        return df.agg(*[values.get(n, F.lit(0)).cast("long").alias(n) if n in values else F.lit(0).cast("long").alias(n)
                        for n in names])

    parts = [
        metrics(persons, total=F.count(F.lit(1)), active=F.count_if(F.col("status") == "active")),
        metrics(docs, indexed=distinct("person_id")), metrics(embeddings, embedded=distinct("person_id")),
        metrics(per_person, multi_source=F.count_if(F.col("n") > 1), profile_covered=F.count_if("a"),
                code_covered=F.count_if("b"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    one = rows.agg(*[F.sum(n).alias(n) for n in names])

    def share(name):
        return F.when(F.col("active") > 0, F.floor(F.col(name) * 100 / F.col("active") + 0.5)).otherwise(0).cast("long")

    return one.select(*names, share("indexed").alias("indexed_pct"), share("embedded").alias("embedded_pct"),
                      share("multi_source").alias("multi_source_pct"))


def coverage_by_source_status(persons, identities, profiles) -> DataFrame:
    """The same coverage as grouping sets (source, status), (source), (status), ()."""
    rows = (persons.select("person_id", "status").join(identities.select("person_id", "profile_id"), "person_id")
            .join(profiles.select("profile_id", "source"), "profile_id"))
    return rows.cube("source", "status").agg(F.countDistinct("person_id").alias("persons"),
                                             F.count(F.lit(1)).alias("links"))


# --- persons and evidence -----------------------------------------------------------------
def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("person_id").agg(F.count(F.lit(1)).alias("evidence_count"))


def rank_features(persons: DataFrame, evidence: DataFrame, now) -> DataFrame:
    kind = F.col("evidence_type")
    counts = evidence.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.count_if(kind == "project").alias("project_count"),
        F.count_if(kind == "repository").alias("repo_count"))
    days = F.floor((F.unix_micros(at(now)) - F.unix_micros("updated_at")) / F.lit(86400000000))
    joined = persons.select("person_id", "updated_at").join(counts, "person_id", "left")
    return joined.select("person_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                        ("evidence_count", "project_count", "repo_count")],
                         F.lit(0).alias("follower_count"), F.coalesce(days, F.lit(0)).cast("int").alias("freshness"))


def follower_signal(evidence: DataFrame, fields=("followers",), scale: float = 1.0) -> DataFrame:
    total = sum((F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in fields), F.lit(0.0))
    return evidence.groupBy("person_id").agg(total.alias("followers")).withColumn(
        "signal", F.lit(scale) * F.log10(F.col("followers") + 1))


def latest_evidence(evidence: DataFrame, work_only: bool = False, fallback=()) -> DataFrame:
    """Newest time of any evidence, or of project/repository items with metadata dates as fallback."""
    rows = evidence.filter(F.col("evidence_type").isin("project", "repository")) if work_only else evidence
    when = F.coalesce(F.col("occurred_at"), first_timestamp(*fallback)) if fallback else F.col("occurred_at")
    return rows.groupBy("person_id").agg(F.max(when).alias("latest_at"))


def merged_summaries(texts: DataFrame) -> DataFrame:
    """(person_id, source, seq, text) -> distinct '[source] text' parts in first-seen order."""
    parts = texts.filter(blank_to_null("text").isNotNull()).select(
        "person_id", "seq", F.concat(F.lit("["), F.col("source"), F.lit("] "), trim_ws("text")).alias("part"))
    first = parts.groupBy("person_id", "part").agg(F.min("seq").alias("seq"))
    return first.groupBy("person_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "\n\n").alias("summary"))


def identity_confidence(scores: DataFrame) -> DataFrame:
    """Mean of positive match scores per person; 0.5 for a single profile or no positive score."""
    agg = scores.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("match_score") > 0, F.col("match_score"))).alias("mean"))
    return agg.select("person_id", F.when(F.col("n") <= 1, 0.5).otherwise(F.coalesce("mean", F.lit(0.5))).alias("confidence"))


def source_links(identities: DataFrame, profiles: DataFrame, website_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(person_id, source, handle, url, display_name, bio) per linked profile, and distinct (person_id, website): the long form of ``source_bundles``."""
    linked = identities.select("person_id", "profile_id")
    rows = linked.join(profiles, "profile_id").select("person_id", "source", "handle", "url", "display_name", "bio")
    sites = website_aliases.join(linked, "profile_id").select("person_id", "website").filter("website IS NOT NULL").distinct()
    return rows, sites


def source_bundles(identities: DataFrame, profiles: DataFrame, website_aliases: DataFrame) -> DataFrame:
    """All linked profiles of a person as one nested value, with the person's website links."""
    rows, sites = source_links(identities, profiles, website_aliases)
    nested = rows.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct(
        "source", "handle", "url", "display_name", "bio"))).alias("sources"))
    sites = sites.groupBy("person_id").agg(F.sort_array(F.collect_list("website")).alias("websites"))
    return nested.join(sites, "person_id", "left").withColumn(
        "websites", F.coalesce("websites", F.array().cast("array<string>")))


# --- community handles ------------------------------------------------------------------------
HANDLE_SETS = ["categories", "category_titles", "names", "descriptions", "source_kinds", "external_sources"]


def handle_facts(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handle, occurrences) and (handle, kind, value) over posts, likes, comments and imports.

    mentions: (handle, source_kind, category, category_title, name, description, external_source).
    Imports count as known, not as an occurrence.
    """
    rows = mentions.filter(blank_to_null("handle").isNotNull()).withColumn("handle", trim_ws("handle"))
    counts = rows.groupBy("handle").agg(F.count_if(F.col("source_kind") != "external_import").alias("occurrences"))
    return counts, distinct_facts(rows, ["handle"], {
        "categories": blank_to_null("category"), "category_titles": F.coalesce(blank_to_null("category_title"), blank_to_null("category")),
        "names": blank_to_null("name"), "descriptions": blank_to_null("description"), "source_kinds": F.col("source_kind"),
        "external_sources": F.col("external_source")})


def accumulate_handles(mentions: DataFrame) -> DataFrame:
    """``handle_facts`` as one row per handle with its sets."""
    return _with_sets(*handle_facts(mentions), "handle", HANDLE_SETS)


def merge_handle_facts(counts: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same handle in several batches, in long form: largest occurrence count, distinct facts."""
    return counts.groupBy("handle").agg(F.max("occurrences").alias("occurrences")), facts.select("handle", "kind", "value").distinct()


def merge_handle_summaries(batches: DataFrame) -> DataFrame:
    """The same handle in several nested batches: their sets are taken apart, merged in long form and nested again."""
    def tagged(name):
        values = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    facts = batches.select("handle", F.explode(F.flatten(F.array(*[tagged(n) for n in HANDLE_SETS]))).alias("m")).select("handle", "m.kind", "m.value")
    return _with_sets(*merge_handle_facts(batches.select("handle", "occurrences"), facts.filter("value IS NOT NULL")), "handle", HANDLE_SETS)


def friend_facts(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sightings of a handle in friend lists: first name, longest description and counts; and (handle, kind, value) of edge types and files."""
    name, text = blank_to_null("name"), blank_to_null("description")
    order, rows = F.col("seen_order"), links.withColumnRenamed("dst", "handle")
    counts = rows.groupBy("handle").agg(
        F.min_by(name, F.when(name.isNotNull(), order)).alias("name"),
        F.min_by(text, F.when(text.isNotNull(), F.struct((-F.length(text)).alias("l"), order.alias("o")))).alias("description"),
        F.count(F.lit(1)).alias("sightings"))
    return counts, distinct_facts(rows, ["handle"], {"edge_types": F.col("edge_type"), "files": F.col("file")})


def friend_previews(links: DataFrame) -> DataFrame:
    """``friend_facts`` as one row per handle with its sets."""
    return _with_sets(*friend_facts(links), "handle", ["edge_types", "files"])


def frontier_facts(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dst, depth, src) sightings -> in-degree and first depth per handle, and distinct (handle, kind, value) of where it was seen."""
    rows = visits.withColumnRenamed("dst", "handle")
    counts = rows.groupBy("handle").agg(F.count(F.lit(1)).alias("incoming"), F.min("depth").alias("first_depth"))
    return counts, distinct_facts(rows, ["handle"], {"discovered_from": F.col("src")})


def frontier_summary(visits: DataFrame) -> DataFrame:
    """``frontier_facts`` as one row per handle with its discovered-from set."""
    return _with_sets(*frontier_facts(visits), "handle", ["discovered_from"])


# --- viewers ---------------------------------------------------------------------------------
def negative_patterns(feedback: DataFrame, now, min_count: int = 3, window_days: int = 30) -> DataFrame:
    since = at(now) - F.expr(f"interval {window_days} days")
    rows = feedback.filter((F.col("sentiment") == "negative") & F.col("reason_code").isNotNull()
                           & (F.col("created_at") > since))
    return rows.groupBy("user_id", "reason_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("earliest_at"), F.max("created_at").alias("latest_at")
    ).filter(F.col("n") >= min_count)


def viewer_snapshot(events: DataFrame) -> DataFrame:
    """Counts per feedback and interaction kind, and how many candidates have state."""
    return events.groupBy("viewer_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in FEEDBACK_KINDS + INTERACTION_KINDS],
        F.countDistinct("person_id").alias("candidates"))


def candidate_state(events: DataFrame, now=None) -> DataFrame:
    """State per (viewer, person) in one order-free aggregation.

    A repeat view is a second or later detail view, an explicit repeat event, or a re-surfacing; so
    repeats = max(details - 1, 0) + repeat events + max(surfacings - 1, 0) whatever the arrival order.
    """
    kind, ts = F.col("kind"), F.col("ts")
    feedback = kind.isin(FEEDBACK_KINDS)
    out = events.groupBy("viewer_id", "person_id").agg(
        F.count_if(kind == "surfaced").alias("seen_count"), F.count_if(kind == "detail_view").alias("detail_count"),
        F.count_if(kind == "repeat_view").alias("_repeat"),
        F.max_by(F.when(feedback, kind), F.when(feedback, F.struct(ts, F.col("event_id")))).alias("last_feedback"),
        F.max(F.when(kind == "surfaced", ts)).alias("last_surfaced_at"),
        F.max(F.when(kind == "contacted", ts)).alias("contacted_at"))
    seen, detail = F.col("seen_count"), F.col("detail_count")
    repeats = F.greatest(detail - 1, F.lit(0)) + F.col("_repeat") + F.greatest(seen - 1, F.lit(0))
    columns = ["viewer_id", "person_id", "seen_count", "detail_count", repeats.alias("repeat_count"), "last_feedback",
               "last_surfaced_at", "contacted_at"]
    if now is not None:
        columns.append(age_days("last_surfaced_at", now).alias("days_since_surfaced"))
    return out.select(*columns)


def bucket_counts(listed: DataFrame) -> DataFrame:
    """Counts per list bucket as columns."""
    buckets = ["new", "high-confidence", "needs-validation", "revisit"]
    return listed.groupBy("viewer_id").agg(*[
        F.count_if(F.col("bucket") == b).alias(b.replace("-", "_")) for b in buckets])


# --- ranked lists ------------------------------------------------------------------------------
BINS, SALTS, FEW_VALUES = 1024, 32, 4096


def exact_median(df: DataFrame, keys, value: str, out: str = "median", few: int = FEW_VALUES) -> DataFrame:
    """Exact median without gathering a group; nulls play no part.

    Equal values are counted before the shuffle. Keys with at most ``few`` distinct values find their middle by running counts, all others by
    ``refined_ranks``, where no task sorts a key.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = cut_lineage(counts)
    sizes = cut_lineage(counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_m")))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))).alias("_at")
    small = counts.join(sizes.filter(F.col("_m") <= few).select(*keys), keys)
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hits = small.withColumn("_upto", upto).join(sizes.select(*keys, middle), keys).filter("_at <= _upto AND _at > _upto - _c").select(*keys, "_v")
    large = sizes.filter(F.col("_m") > few)
    if not large.isEmpty():
        hits = hits.unionByName(refined_ranks(counts, large.select(*keys, middle), keys).select(*keys, "_v"))
    return hits.groupBy(*keys).agg(F.avg("_v").alias(out))


def refined_ranks(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _at, _v): the value at each rank, from counts (keys, _v, _c) and targets (keys, _at), by narrowing value ranges.

    Each round deals the values that are still in the range of a target into ``BINS`` equal bins, counts them with partial aggregation and goes on with
    the one bin that holds the rank. A round leaves a thousandth of evenly spread values; it always leaves fewer, as a bin never holds
    both ends of a range. Counts and targets meet over ``SALTS`` hashed parts, so a hot key is no hot partition.
    """
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    finite = (F.abs("_v") < float("inf")) & ~F.isnan("_v")
    live = targets.withColumns({"_from": F.lit(None).cast("double"), "_to": F.lit(None).cast("double"), "_left": F.col("_at")})
    ends = counts.filter(finite).groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    live = cut_lineage(live.join(ends, keys, "left"))
    found = None
    while not live.isEmpty():
        rows = salted.join(live.withColumn("_salt", parts), [*keys, "_salt"])
        rows = rows.filter(F.col("_from").isNull() | ((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))))
        # Halves, because the distance of two doubles may be no double.
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.when(F.isnan("_v"), BINS + 1).when(F.col("_v") == float("inf"), BINS).when(F.col("_v") == float("-inf"), -1).when(
            F.col("_lo") == F.col("_hi"), 0).when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(F.least(F.lit(BINS - 2), F.floor(share * (BINS - 1))))
        bins = rows.groupBy(*keys, "_at", "_left", bin_.cast("int").alias("_bin")).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_at").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        hit = bins.withColumn("_upto", upto).filter((F.col("_left") <= F.col("_upto")) & (F.col("_left") > F.col("_upto") - F.col("_n")))
        hit = cut_lineage(hit.select(*keys, "_at", "_from", "_to", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi")))
        done = hit.filter("_from = _to").select(*keys, "_at", F.col("_from").alias("_v"))
        found = done if found is None else found.unionByName(done)
        live = hit.filter("_from < _to")
    return found


def score_distribution(hits: DataFrame, bounded: bool = False) -> DataFrame:
    """min, max, exact median, top-3 average and top gap per query.

    ``bounded=True`` is for lists already cut to a top-k, where the built-in median is cheaper.
    """
    base = hits.groupBy("query_id").agg(F.min("score").alias("min"), F.max("score").alias("max"),
                                        *([F.median("score").alias("median")] if bounded else []))
    if not bounded:
        base = base.join(exact_median(hits, ["query_id"], "score"), "query_id")
    head = top_k(hits.select("query_id", "person_id", "score"), ["query_id"], [F.desc("score"), "person_id"], 3)
    tops = head.groupBy("query_id").agg(
        F.avg("score").alias("top3_avg"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_first"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"))
    return base.join(tops, "query_id").select(
        "query_id", "min", "max", "median", "top3_avg",
        F.coalesce(F.col("_first") - F.col("_second"), F.lit(0.0)).alias("gap"))


def strength_histogram(hits: DataFrame) -> DataFrame:
    s, n = F.col("strength"), F.size("reasons")
    known = ["weak", "medium", "strong"]
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in known],
        F.count_if(s.isNull() | ~s.isin(known)).alias("unknown"), F.min(n).alias("reason_min"),
        F.max(n).alias("reason_max"), F.avg(n).alias("reason_avg"), F.count_if(n <= 1).alias("thin"),
        (F.max(n) <= 1).alias("all_thin"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """(query_id, label, status) rows -> totals and the three most frequent unmet labels."""
    totals = audit.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("met", "unmet", "unknown")])
    unmet = audit.filter("status = 'unmet'").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    head = top_k(unmet, ["query_id"], [F.desc("n"), "label"], 3)
    labels = head.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))),
                                                      lambda x: x["label"]).alias("unmet_labels"))
    return totals.join(labels, "query_id", "left")


def source_spread(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count_if(F.size("sources") == 1).alias("single_source"),
                                        F.count_if(F.size("sources") > 1).alias("multi_source"))


def filter_dropoff(failed: DataFrame) -> DataFrame:
    """(query_id, failed array) -> count per filter and the dominant one ('unknown' when none failed)."""
    rows = failed.select("query_id", F.explode_outer("failed").alias("filter"))
    counts = rows.groupBy("query_id", "filter").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("filter").isNotNull()
    return counts.groupBy("query_id").agg(
        *[F.coalesce(F.max(F.when(F.col("filter") == f, F.col("n"))), F.lit(0)).alias(f)
          for f in ("must_have", "exclude", "source_bias")],
        F.coalesce(F.max_by(F.when(named, F.col("filter")), F.when(named, F.struct("n", "filter"))), F.lit("unknown"))
        .alias("dominant"))


# --- imports ------------------------------------------------------------------------------------
def completeness_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two versions of payload summaries joined on handle; how often the right one is richer.

    Both sides: (handle, payload, has_name, has_info, n_items)
    """
    l = left.select("handle", *[F.col(c).alias(f"l_{c}") for c in ("payload", "has_name", "has_info", "n_items")])
    r = right.select("handle", *[F.col(c).alias(f"r_{c}") for c in ("payload", "has_name", "has_info", "n_items")])
    both = l.join(r, "handle", "full_outer")
    ok_l, ok_r = F.col("l_payload").isNotNull(), F.col("r_payload").isNotNull()

    def false(c):
        return F.coalesce(F.col(c), F.lit(False))

    return both.agg(
        F.count(F.lit(1)).alias("handles"), F.count_if(ok_l).alias("left_ok"), F.count_if(ok_r).alias("right_ok"),
        F.count_if(F.col("l_payload") == F.col("r_payload")).alias("identical"),
        F.count_if(F.col("l_payload") != F.col("r_payload")).alias("different"),
        F.count_if(~false("l_has_name") & false("r_has_name")).alias("richer_name"),
        F.count_if(~false("l_has_info") & false("r_has_info")).alias("richer_info"),
        F.count_if(F.coalesce("r_n_items", F.lit(0)) > F.coalesce("l_n_items", F.lit(0))).alias("richer_items"))
