"""Handle graph: bounded crawl over landed edges, seed lists, import filters, signal report."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import or_empty
from ..functions.text import alias_mention, blank_to_null, trim_ws
from ..session import cut_lineage
from .aggregates import frontier_summary
from .common import best_row, distinct_values, top_k
from .windows import collapse_aliases, seed_order

VISIBLE_KINDS = ["category", "global_timeline", "profile_timeline"]


def crawl(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """Breadth-first crawl: (handle, first_depth, incoming, discovered_from) of every handle seen.

    Level by level; when a level is larger than the remaining node budget the handles first in order are
    taken. A node's neighbours are seen once it is visited; a seed has depth 0.
    """
    edges = edges.select("src", "dst")
    frontier = cut_lineage(seeds.select(F.col("handle").alias("node")).distinct())
    known, sightings, visited = frontier, None, 0
    for level in range(depth + 1):
        left = max_nodes - visited
        if left <= 0:
            break
        frontier = cut_lineage(frontier.orderBy("node").limit(left))
        size = frontier.count()
        if size == 0:
            break
        visited += size
        seen = cut_lineage(edges.join(frontier.select(F.col("node").alias("src")), "src").withColumn("depth", F.lit(level + 1)))
        sightings = seen if sightings is None else sightings.unionByName(seen)
        fresh = seen.select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        frontier = cut_lineage(fresh)
        known = known.unionByName(frontier)
    roots = seeds.select(F.col("handle")).distinct().withColumn("_root", F.lit(True))
    summary = frontier_summary(sightings) if sightings is not None else None
    if summary is None:
        return roots.select("handle", F.lit(0).alias("first_depth"), F.lit(0).cast("long").alias("incoming"),
                            F.array().cast("array<string>").alias("discovered_from"))
    j = roots.join(summary, "handle", "full_outer")
    return j.select("handle", F.when(F.col("_root"), 0).otherwise(F.col("first_depth")).alias("first_depth"),
                    F.coalesce("incoming", F.lit(0)).alias("incoming"), or_empty("discovered_from").alias("discovered_from"))


# --- seed lists -----------------------------------------------------------------------------
def merge_seed_batches(records: DataFrame) -> DataFrame:
    """The same handle from many batches. records: (handle, name, occurrences, source_kinds, batch, fresh)."""
    r = records.withColumn("handle", trim_ws("handle")).filter("handle <> ''")
    name = F.nullif("name", F.lit(""))
    fresh = F.coalesce("fresh", F.lit(False)) if "fresh" in records.columns else F.lit(False)
    tops = r.groupBy("handle").agg(
        F.min_by(name, F.when(name.isNotNull(), F.struct((~fresh).alias("h"), F.col("batch").alias("b")))).alias("name"),
        F.max(F.coalesce("occurrences", F.lit(1))).alias("occurrences"), F.count_if(fresh).alias("fresh_count"),
        F.count_if(~fresh).alias("history_count"))
    kinds = distinct_values(r.select("handle", F.explode("source_kinds").alias("k")), ["handle"], "k", "source_kinds")
    return tops.join(kinds, "handle", "left").withColumn("source_kinds", or_empty("source_kinds"))


def is_visible(kinds: Column) -> Column:
    return F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in VISIBLE_KINDS]))


def seed_exclusion(merged: DataFrame, excluded: DataFrame, *, min_occurrences: int = 1, drop_pure_likes: bool = True,
                   require_visible: bool = False, require_name: bool = False, required=(), forbidden=()) -> DataFrame:
    """Add ``reason``: the first filter a seed fails, null when it passes all."""
    kinds = F.col("source_kinds")
    out = merged.join(excluded.select("handle").distinct().withColumn("_x", F.lit(True)), "handle", "left")
    lacks = reduce(lambda a, b: a | b, [~F.array_contains(kinds, k) for k in required], F.lit(False))
    has = reduce(lambda a, b: a | b, [F.array_contains(kinds, k) for k in forbidden], F.lit(False))
    only_like = (F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == "post_like")
    reason = (F.when(F.col("_x"), "file").when(F.col("occurrences") < min_occurrences, "min_occurrences")
              .when(only_like & F.lit(drop_pure_likes), "pure_post_like").when(~is_visible(kinds) & F.lit(require_visible), "not_visible")
              .when(F.col("name").isNull() & F.lit(require_name), "missing_name").when(lacks, "required_kind").when(has, "excluded_kind"))
    return out.withColumn("reason", reason).drop("_x")


def frontier_seeds(records: DataFrame, excluded: DataFrame, limit: int, skip: int = 0, **filters) -> DataFrame:
    kept = seed_exclusion(merge_seed_batches(records), excluded, **filters).filter("reason IS NULL").drop("reason")
    return seed_order(kept, limit, skip)


def seed_scores(merged: DataFrame, keywords=()) -> DataFrame:
    """Score of a fresh seed: occurrences up to 5, fresh 3, repeated 1, named 2, comment 2, import 2, visible 1, keywords up to 2, two kinds 1."""
    kinds, text = F.col("source_kinds"), F.lower(F.concat_ws(" ", "handle", F.coalesce("name", F.lit(""))))
    words = sum((F.when(text.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))

    def flag(condition, value):
        return F.when(condition, value).otherwise(0)

    score = (F.least(F.col("occurrences"), F.lit(5)) + flag(F.col("fresh_count") > 0, 3) + flag(F.col("fresh_count") > 1, 1)
             + flag(F.col("name").isNotNull(), 2) + flag(F.array_contains(kinds, "post_comment"), 2)
             + flag(F.array_contains(kinds, "external_import"), 2) + flag(is_visible(kinds), 1) + F.least(F.lit(2), words)
             + flag(F.size(kinds) >= 2, 1))
    return merged.withColumn("score", score.cast("int"))


def fresh_seeds(records: DataFrame, excluded: DataFrame, limit: int = 50, skip: int = 0, keywords=(), **filters) -> DataFrame:
    kept = seed_exclusion(merge_seed_batches(records), excluded, **filters).filter("reason IS NULL").drop("reason")
    ranked = seed_scores(kept, keywords)
    return ranked.orderBy(F.desc("score"), F.desc("occurrences"), F.desc("fresh_count"), F.desc(F.col("name").isNotNull()),
                          F.desc(F.size("source_kinds")), "handle").offset(skip).limit(limit)


# --- import filters ----------------------------------------------------------------------------
def tag_imports(records: DataFrame, stored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every input record with the reason it is dropped, null when it goes on.

    records: (handle, name, source_profile_id, seq). First come repeated handles, then aliases of the same
    profile, then stored profile ids, stored handles and excluded handles.
    """
    r = records.withColumn("handle", trim_ws("handle")).filter("handle <> ''")
    first = best_row(r.select("handle", "seq"), ["handle"], F.col("seq"), maximum=False).withColumn("_first", F.lit(True))
    r = r.join(first, ["handle", "seq"], "left")
    kept = collapse_aliases(r.filter("_first").select("handle", "source_profile_id", "seq")).select("seq").withColumn("_kept", F.lit(True))
    ids = stored.select(blank_to_null("source_profile_id").alias("source_profile_id")).filter(
        "source_profile_id IS NOT NULL").distinct().withColumn("_id", F.lit(True))
    handles = stored.select("handle").distinct().withColumn("_stored", F.lit(True))
    files = excluded.select("handle").distinct().withColumn("_file", F.lit(True))
    j = (r.join(kept, "seq", "left").join(ids, "source_profile_id", "left").join(handles, "handle", "left").join(files, "handle", "left"))
    reason = (F.when(F.col("_first").isNull(), "duplicate").when(F.col("_kept").isNull(), "collapsed_alias").when(F.col("_id"), "stored_id")
              .when(F.col("_stored"), "stored_handle").when(F.col("_file"), "excluded_file"))
    return j.select("handle", "name", "source_profile_id", "seq", reason.alias("reason"))


def import_summary(tagged: DataFrame) -> DataFrame:
    """Count per drop reason; 'imported' for the rest, and a grand total row with a null reason (rollup)."""
    return tagged.select(F.coalesce("reason", F.lit("imported")).alias("reason")).rollup("reason").agg(F.count(F.lit(1)).alias("n"))


def enrich_sparse(existing: DataFrame, previews: DataFrame) -> DataFrame:
    """Fill only empty fields of stored profiles from friend previews; rich profiles stay as they are.

    existing: (profile_id, handle, display_name, bio, avatar, is_rich); previews: (handle, name, description, avatar).
    """
    p = previews.select("handle", F.col("name").alias("p_name"), F.col("description").alias("p_text"), F.col("avatar").alias("p_avatar"))
    j = existing.join(p, "handle", "left")
    free = ~F.col("is_rich")

    def fill(column, preview):
        return F.when(free, F.coalesce(column, preview)).otherwise(F.col(column))

    out = j.select("profile_id", "handle", fill("display_name", "p_name").alias("new_name"), fill("bio", "p_text").alias("new_bio"),
                   fill("avatar", "p_avatar").alias("new_avatar"), "display_name", "bio", "avatar", "is_rich")
    same = (F.col("new_name").eqNullSafe(F.col("display_name")) & F.col("new_bio").eqNullSafe(F.col("bio"))
            & F.col("new_avatar").eqNullSafe(F.col("avatar")))
    return out.select("profile_id", "handle", F.col("new_name").alias("display_name"), F.col("new_bio").alias("bio"),
                      F.col("new_avatar").alias("avatar"), (~same).alias("changed"))


def expansion_targets(leads: DataFrame, seeds: DataFrame, edges: DataFrame, budget: int = 20, max_seeds: int = 5,
                      per_seed: int = 10) -> DataFrame:
    """Work list under a budget: open leads first, then up to ten neighbours of each of the best seeds.

    leads: (handle, seq); seeds: (handle, confidence); edges: (src, dst, seq). The budget is a feature of the
    operator; at most budget + max_seeds x per_seed rows ever meet in the running sum.
    """
    first = leads.orderBy("seq", "handle").limit(budget).select("handle", F.lit("lead").alias("via"), F.lit(0).alias("step"),
                                                                F.col("seq").cast("long").alias("seq"))
    best = top_k(seeds.withColumn("_all", F.lit(1)), ["_all"], [F.desc("confidence"), "handle"], max_seeds, "step")
    near = edges.join(best.select(F.col("handle").alias("src"), "step"), "src")
    near = top_k(near, ["src"], ["seq", "dst"], per_seed, "_k").select(
        F.col("dst").alias("handle"), F.concat(F.lit("neighbour of "), F.col("src")).alias("via"), "step", F.col("_k").cast("long").alias("seq"))
    rows = first.unionByName(near)
    w = Window.partitionBy(F.lit(1)).orderBy("step", "seq", "handle").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.lit(1)).over(w)).filter(F.col("used") <= budget)


# --- signal report --------------------------------------------------------------------------------
def signal_report(profiles: DataFrame, context: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Profiles mentioning any keyword family in their own text or their community context.

    profiles: (handle, own_text); context: (handle, context_text, posts). Families are a parameter.
    """
    def hits(text):
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [alias_mention(low, a) for a in words]), F.lit(name))
                                         for name, words in families.items()]))

    j = profiles.join(context, "handle", "left").withColumns({"own": hits(F.col("own_text")), "around": hits(F.col("context_text"))})
    signals = F.array_distinct(F.concat("own", "around"))
    where = F.array_compact(F.array(F.when(F.size("own") > 0, "profile"), F.when(F.size("around") > 0, "community_context")))
    return j.select("handle", signals.alias("signals"), where.alias("hit_sources"), F.coalesce("posts", F.lit(0)).alias("posts")).filter(
        F.size("signals") > 0)

