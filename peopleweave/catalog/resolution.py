"""Queries for identity resolution, de-duplication and the handle graph."""
from pyspark.sql import functions as F

from ..bindings import HALF, Tables, half, with_sql
from ..operators import dedupe, graph, identity
from ..operators.aggregates import friend_previews
from .registry import query


def sides(t: Tables):
    p = t.profiles().withColumn("companies", F.array(F.concat("company", F.lit(".")))).withColumn(
        "linked_handles", F.when(F.col("link_handle").isNotNull(), F.array("link_handle")))
    return p.filter("source = 'bonjour'"), p.filter("source = 'github'")


PAIRS = """pairs AS (SELECT a.profile_id AS left_id, b.profile_id AS right_id, a.ordinal AS lo, b.ordinal AS ro,
  CASE WHEN a.link_handle = b.handle THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ns + ls + cs) END AS score, coalesce(a.link_handle = b.handle, FALSE) AS linked
  FROM profiles a JOIN profiles b ON a.source = 'bonjour' AND b.source = 'github', LATERAL (SELECT
    CASE WHEN a.display_name = b.display_name THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS ns,
    CASE WHEN a.location = b.location THEN 0.3::DOUBLE WHEN split_part(a.location, ' / ', 1) = split_part(b.location, ' / ', 1) THEN CASE WHEN contains(a.location, 'MIDDLE EAST') THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END ELSE 0.0::DOUBLE END AS ls,
    CASE WHEN contains(b.bio, a.company || '.') OR contains(a.bio, b.company || '.') THEN 0.2::DOUBLE WHEN a.headline = 'engineer' AND b.headline = 'engineer' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS cs)
  WHERE least(1.0::DOUBLE, ns + ls + cs) >= 0.7 OR a.link_handle = b.handle)"""
OWNERS = """known AS (SELECT profile_id, person_id FROM identities),
m AS (SELECT p.*, kl.person_id AS lp, kr.person_id AS rp FROM pairs p LEFT JOIN known kl ON kl.profile_id = left_id LEFT JOIN known kr ON kr.profile_id = right_id)"""


@query("jn9_candidate_pairs", with_sql(["profiles"], "SELECT left_id, right_id, score FROM pairs", PAIRS))
def jn9(t: Tables):
    a, b = (identity.prepare(x) for x in sides(t))
    lists = identity.preference_lists(a, b)
    left = a.select(F.col("profile_id").alias("left_id"), "group")
    return left.join(lists, "group").select("left_id", "right_id", "score")


@query("idn1_explicit_links", with_sql(["profiles"], "SELECT left_id, right_id FROM pairs WHERE linked", PAIRS))
def idn1(t: Tables):
    a, b = (identity.prepare(x) for x in sides(t))
    return identity.explicit_pairs(a, b)


@query("idn2_fuzzy_scores", with_sql(["profiles"], "SELECT left_id, right_id, round(score, 9) AS score FROM pairs WHERE NOT linked", PAIRS))
def idn2(t: Tables):
    a, b = (identity.prepare(x) for x in sides(t))
    pairs = identity.signature_pairs(a, b)
    rows = a.select(F.col("profile_id").alias("left_id"), F.col("sig").alias("sig_a")).join(pairs, "sig_a").join(
        b.select(F.col("profile_id").alias("right_id"), F.col("sig").alias("sig_b")), "sig_b")
    return rows.join(identity.explicit_pairs(a, b), ["left_id", "right_id"], "left_anti").select("left_id", "right_id", F.round("score", 9).alias("score"))


# In these tables a left profile meets a right one of its own number only, so the greedy walk has no contention.
@query("idn3_assignment", with_sql(["profiles", "identities"], "SELECT left_id, right_id, score FROM m WHERE score >= 0.9 AND NOT coalesce(lp <> rp, FALSE)", PAIRS + "," + OWNERS))
def idn3(t: Tables):
    a, b = sides(t)
    return identity.resolve(a, b, t.identities())["matches"].select("left_id", "right_id", "score")


def crossed(t: Tables):
    """Identities in which every right profile already belongs to another person."""
    i = t.identities()
    return i.withColumn("person_id", F.when(F.col("profile_id").startswith("b"), F.col("person_id") + 1000000).otherwise(F.col("person_id")))


@query("idn4_conflicts", with_sql(["profiles", "identities"], "SELECT left_id, right_id, score FROM m WHERE score >= 0.9 AND lp IS NOT NULL AND rp IS NOT NULL", PAIRS + "," + OWNERS))
def idn4(t: Tables):
    a, b = sides(t)
    return identity.resolve(a, b, crossed(t))["conflicts"]


@query("idn3_review", with_sql(["profiles", "identities"], "SELECT left_id, round(max(score), 9) AS score FROM m WHERE score < 0.9 GROUP BY 1", PAIRS + "," + OWNERS))
def idn3_review(t: Tables):
    a, b = sides(t)
    return identity.resolve(a, b, t.identities())["review"].withColumn("score", F.round("score", 9))


@query("idn5_singletons", with_sql(["profiles", "identities"], """
SELECT profile_id FROM profiles WHERE profile_id NOT IN (SELECT profile_id FROM known) AND profile_id NOT IN (SELECT unnest([left_id, right_id]) FROM m WHERE score >= 0.9 AND NOT coalesce(lp <> rp, FALSE))""", PAIRS + "," + OWNERS))
def idn5(t: Tables):
    a, b = sides(t)
    return identity.resolve(a, b, t.identities())["singletons"]


@query("idn6_person_build", with_sql(["identities", "profiles", "persons"], """
SELECT p.person_id, coalesce(b.name, p.name) AS name, coalesce(b.headline, p.headline) AS headline, greatest(p.confidence, coalesce(b.confidence, 0)) AS confidence FROM persons p LEFT JOIN (
  SELECT person_id, arg_min(display_name, (source <> 'bonjour', ordinal)) AS name, arg_min(headline, (source <> 'bonjour', ordinal)) FILTER (headline IS NOT NULL) AS headline,
    CASE WHEN count(*) <= 1 THEN 0.5 ELSE avg(match_score) END AS confidence FROM identities JOIN profiles USING (profile_id) GROUP BY 1) b ON b.person_id = p.person_id"""))
def idn6(t: Tables):
    p = t.profiles().withColumn("summary", F.lit(None).cast("string"))
    built = identity.build_persons(t.identities().select("person_id", "profile_id", "match_score"), p)
    return identity.attach_to_persons(t.persons(), built).select("person_id", "name", "headline", "confidence")


@query("idn7_alias_registration", with_sql(["identities", "profiles"], """
SELECT DISTINCT person_id, source AS alias_type, handle AS alias_value FROM identities JOIN profiles USING (profile_id)
UNION SELECT person_id, 'other', company FROM identities JOIN profiles USING (profile_id)"""))
def idn7(t: Tables):
    p = t.profiles().select("profile_id", "source", "handle", F.array(F.struct(F.lit("other").alias("type"), F.col("company").alias("value"), F.lit(0.6).alias("confidence"))).alias("aliases"))
    return identity.alias_rows(t.identities(), p).select("person_id", "alias_type", "alias_value")


@query("idn8_person_by_alias", with_sql(["identities", "profiles"], """
SELECT 'github' AS alias_type, handle AS alias_value, min(person_id) AS person_id FROM identities JOIN profiles USING (profile_id) WHERE source = 'github' GROUP BY 2"""))
def idn8(t: Tables):
    p = t.profiles().select("profile_id", "source", "handle", F.lit(None).cast("array<struct<type:string,value:string,confidence:double>>").alias("aliases"))
    wanted = t.raw("supplier").select(F.lit("github").alias("alias_type"), F.concat(F.lit("supp"), F.col("s_suppkey")).alias("alias_value"))
    return identity.persons_by_alias(identity.alias_rows(t.identities(), p), wanted)


@query("idn9_headline_backfill", with_sql(["identities", "profiles", "persons"], """
SELECT person_id, h AS new_headline FROM persons JOIN (SELECT person_id, arg_min(p.headline, (source <> 'bonjour', ordinal)) FILTER (p.headline IS NOT NULL) AS h
  FROM identities JOIN profiles p USING (profile_id) GROUP BY 1) USING (person_id) WHERE h IS NOT NULL AND h IS DISTINCT FROM headline"""))
def idn9(t: Tables):
    p = t.profiles().withColumn("summary", F.lit(None).cast("string"))
    built = identity.build_persons(t.identities().select("person_id", "profile_id", "match_score"), p)
    return identity.backfill_headlines(t.persons(), built)


# --- de-duplication -------------------------------------------------------------------------
STRONG = """strong AS (SELECT DISTINCT person_id, alias_type || ':' || lower(substr(alias_value, 2)) AS alias_key, alias_type FROM alias_rows WHERE confidence >= 1)"""
EDGES = STRONG + """, who AS (SELECT person_id, alias_key, alias_type, lower(name) AS name, lower(location) AS place FROM strong JOIN persons USING (person_id)),
edges AS (SELECT DISTINCT a.person_id AS src, b.person_id AS dst FROM who a JOIN who b ON a.alias_key = b.alias_key AND a.person_id <> b.person_id
  AND (a.place = b.place OR contains(a.name, b.name) OR contains(b.name, a.name)))"""
COMPONENTS = EDGES + """, reach AS (SELECT src AS node, src AS low FROM edges UNION SELECT e.dst, r.low FROM reach r JOIN edges e ON e.src = r.node AND r.low < e.dst),
comp AS (SELECT node, min(low) AS component FROM reach GROUP BY 1)"""


def strong(t: Tables):
    return dedupe.strong_aliases(t.alias_rows())


def people(t: Tables):
    """Persons named by their number's last three digits, so some names repeat inside alias groups."""
    return t.persons().withColumn("name", F.concat(F.lit("P"), F.lpad((F.col("person_id") % 7).cast("string"), 2, "0"), F.lit(" x"))).withColumn(
        "location", F.col("location"))


PEOPLE_EDGES = EDGES.replace("lower(name) AS name", "'p' || lpad(CAST(person_id % 7 AS VARCHAR), 2, '0') || ' x' AS name")
PEOPLE_COMPONENTS = COMPONENTS.replace("lower(name) AS name", "'p' || lpad(CAST(person_id % 7 AS VARCHAR), 2, '0') || ' x' AS name")


@query("ded1_strong_aliases", with_sql(["alias_rows"], "SELECT person_id, alias_key, alias_type FROM strong", STRONG))
def ded1(t: Tables):
    return strong(t)


@query("jn10_alias_pairs_linked", with_sql(["alias_rows", "persons"], "SELECT src AS node FROM edges UNION SELECT dst FROM edges", PEOPLE_EDGES))
def jn10(t: Tables):
    # Star edges in place of all pairs: the same nodes are linked, and by ded3 the same components.
    e = dedupe.alias_edges(strong(t), people(t))
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query("ded2_edge_degrees", with_sql(["alias_rows", "persons"], """
SELECT count(DISTINCT alias_key) AS groups_with_edges, count(DISTINCT n) AS nodes FROM (SELECT a.alias_key, unnest([a.person_id, b.person_id]) AS n FROM who a JOIN who b ON a.alias_key = b.alias_key AND a.person_id < b.person_id
  AND (a.place = b.place OR a.name = b.name))""", PEOPLE_EDGES))
def ded2(t: Tables):
    s, p = strong(t), people(t)
    held = s.join(p.select("person_id", "name", "location"), "person_id")
    keys = held.groupBy("alias_key", "location").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("alias_key").unionByName(
        held.groupBy("alias_key", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("alias_key"))
    e = dedupe.alias_edges(s, p)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    rows = keys.distinct().select(F.lit("g").alias("k"), F.col("alias_key").alias("v")).unionByName(
        nodes.distinct().select(F.lit("n").alias("k"), F.col("node").cast("string").alias("v")))
    return rows.agg(F.count_if(F.col("k") == "g").alias("groups_with_edges"), F.count_if(F.col("k") == "n").alias("nodes"))


@query("ded3_components", with_sql(["alias_rows", "persons"], "SELECT node, component FROM comp", PEOPLE_COMPONENTS))
def ded3(t: Tables):
    return dedupe.connected_components(dedupe.alias_edges(strong(t), people(t)))


WIN = """stats AS (SELECT component, node AS person_id, (SELECT count(*) FROM identities i WHERE i.person_id = node) AS ni, (SELECT count(*) FROM evidence e WHERE e.person_id = node) AS ne, created_at
  FROM comp JOIN persons ON persons.person_id = node),
win AS (SELECT component, arg_min(person_id, (-ni, -ne, created_at, person_id)) AS winner FROM stats GROUP BY 1)"""


def winners(t: Tables):
    c = dedupe.connected_components(dedupe.alias_edges(strong(t), people(t)))
    return dedupe.choose_winners(c, t.persons(), t.identities(), t.evidence())


@query("ded4_merge", with_sql(["alias_rows", "persons", "identities", "evidence"], """
SELECT profile_id, coalesce(winner, i.person_id) AS person_id FROM identities i LEFT JOIN comp ON node = i.person_id LEFT JOIN win USING (component)""", PEOPLE_COMPONENTS + "," + WIN))
def ded4(t: Tables):
    merged = dedupe.merge_persons(winners(t), t.persons(), t.identities(), t.search_docs(), t.embeddings())
    return merged["identities"].select("profile_id", "person_id")


@query("ded4_reasons", with_sql(["alias_rows", "persons", "identities", "evidence"], """
SELECT node AS person_id, winner, coalesce((SELECT list_sort(array_agg(DISTINCT 'strong_alias_' || a.alias_type)) FROM who a JOIN who b ON a.alias_key = b.alias_key AND a.person_id = node AND b.person_id = winner
    AND (a.place = b.place OR a.name = b.name)), ['strong_alias_dedupe']) AS signals
FROM comp JOIN win USING (component) WHERE node <> winner""", PEOPLE_COMPONENTS + "," + WIN))
def ded4_reasons(t: Tables):
    return dedupe.merge_reasons(winners(t), strong(t), people(t))


# --- graph -----------------------------------------------------------------------------------
@query("grf1_bounded_crawl", with_sql(["links"], """
SELECT coalesce(d, seed) AS handle, CASE WHEN seed IS NOT NULL THEN 0 ELSE first_depth END AS first_depth, coalesce(incoming, 0) AS incoming, coalesce(src_set, []) AS discovered_from FROM seeds FULL JOIN (
  SELECT dst AS d, min(depth) AS first_depth, count(*) AS incoming, list_sort(array_agg(DISTINCT src)) AS src_set FROM seen GROUP BY 1) ON d = seed""", """
both_ways AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links), seeds AS (SELECT 'supp' || s_suppkey AS seed FROM supplier WHERE s_acctbal > 9500),
f0 AS (SELECT seed AS node FROM seeds ORDER BY 1 LIMIT 300), s0 AS (SELECT e.src, e.dst, 1 AS depth FROM both_ways e JOIN f0 ON node = src),
f1 AS (SELECT node FROM (SELECT DISTINCT dst AS node FROM s0 EXCEPT SELECT node FROM f0) ORDER BY 1 LIMIT (SELECT 300 - count(*) FROM f0)), s1 AS (SELECT e.src, e.dst, 2 AS depth FROM both_ways e JOIN f1 ON node = src),
seen AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"""))
def grf1(t: Tables):
    e = t.links().select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = t.raw("supplier").filter("s_acctbal > 9500").select(F.concat(F.lit("supp"), F.col("s_suppkey")).alias("handle"))
    return graph.crawl(both, seeds, depth=1, max_nodes=300)


def seed_records(t: Tables):
    """Seed batches: one record per post reference, batch = category, urgent posts count as fresh."""
    r = t.post_refs()
    return r.select("handle", "name", (F.col("weight") / 10).cast("int").alias("occurrences"), F.array("source_kind").alias("source_kinds"),
                    F.col("category").alias("batch"), (F.col("category") == "1-urgent").alias("fresh"))


def excluded(t: Tables):
    return t.raw("supplier").filter("s_acctbal < 0").select(F.concat(F.lit("supp"), F.col("s_suppkey")).alias("handle"))


MERGED = """merged AS (SELECT handle, arg_min(name, (category <> '1-urgent', category)) FILTER (name IS NOT NULL) AS name, max(CAST(trunc(weight / 10) AS INT)) AS occurrences,
  list_sort(array_agg(DISTINCT source_kind)) AS kinds, count_if(category = '1-urgent') AS fresh FROM post_refs GROUP BY 1),
kept AS (SELECT * FROM merged WHERE handle NOT IN (SELECT 'supp' || s_suppkey FROM supplier WHERE s_acctbal < 0) AND occurrences >= 5 AND NOT (length(kinds) = 1 AND kinds[1] = 'post_like'))"""


@query("grf2_frontier_seeds", with_sql(["post_refs"], """
SELECT handle, occurrences, name FROM kept WHERE contains(kinds, 'external_import') AND contains(kinds, 'category') ORDER BY occurrences DESC, name IS NOT NULL DESC, length(kinds) DESC, handle LIMIT 30 OFFSET 5""", MERGED))
def grf2(t: Tables):
    return graph.frontier_seeds(seed_records(t), excluded(t), limit=30, skip=5, min_occurrences=5, require_visible=True,
                                required=["external_import"]).select("handle", "occurrences", "name")


@query("grf3_fresh_seeds", with_sql(["post_refs"], """
SELECT handle, least(occurrences, 5) + CASE WHEN fresh > 0 THEN 3 ELSE 0 END + CASE WHEN fresh > 1 THEN 1 ELSE 0 END + CASE WHEN name IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN contains(kinds, 'post_comment') THEN 2 ELSE 0 END
  + CASE WHEN contains(kinds, 'external_import') THEN 2 ELSE 0 END + CASE WHEN contains(kinds, 'category') THEN 1 ELSE 0 END + contains(handle || ' ' || lower(coalesce(name, '')), 'supp1')::INT + CASE WHEN length(kinds) >= 2 THEN 1 ELSE 0 END AS score
FROM kept ORDER BY score DESC, occurrences DESC, fresh DESC, name IS NOT NULL DESC, length(kinds) DESC, handle LIMIT 50""", MERGED))
def grf3(t: Tables):
    return graph.fresh_seeds(seed_records(t), excluded(t), limit=50, keywords=["supp1"], min_occurrences=5).select("handle", "score")


@query("grf3_exclusion_counts", with_sql(["post_refs"], """
SELECT CASE WHEN handle IN (SELECT 'supp' || s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'file' WHEN occurrences < 5 THEN 'min_occurrences' WHEN length(kinds) = 1 AND kinds[1] = 'post_like' THEN 'pure_post_like' END AS reason, count(*) AS n FROM merged GROUP BY 1""", MERGED))
def grf3_counts(t: Tables):
    tagged = graph.seed_exclusion(graph.merge_seed_batches(seed_records(t)), excluded(t), min_occurrences=5)
    return tagged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def imports(t: Tables):
    """Links as landed rows; three handles whose numbers follow each other share a profile id."""
    number = F.floor(F.expr("CAST(substring(dst, 5) AS BIGINT)") / 3).cast("string")
    return t.links().select(F.col("dst").alias("handle"), "name", F.when(F.col("edge_type") == "friend", F.concat(F.lit("id"), number)).alias("source_profile_id"),
                            F.col("seen_order").alias("seq"))


def stored_handles(t: Tables):
    return t.profiles().filter("source = 'bonjour'").filter(half("handle")).select("handle", F.when(half("ordinal"), F.concat(F.lit("id"), F.col("ordinal"))).alias("source_profile_id"))


IMPORT = f"""r AS (SELECT dst AS handle, CASE WHEN edge_type = 'friend' THEN 'id' || (CAST(substr(dst, 5) AS BIGINT) // 3) END AS pid, seen_order AS seq, row_number() OVER (PARTITION BY dst ORDER BY seen_order) AS rn FROM links),
c AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN pid IS NOT NULL THEN 'profile:' || pid ELSE 'handle:' || handle END ORDER BY seq) AS cn FROM r WHERE rn = 1),
sto AS MATERIALIZED (SELECT 'cust' || c_custkey AS h, CASE WHEN {HALF.format('c_custkey')} THEN 'id' || c_custkey END AS i, {HALF.format("'cust' || c_custkey")} AS stored, c_acctbal < 0 AS out FROM customer),
one AS MATERIALIZED (SELECT r.handle, r.seq, r.pid, r.rn, c.cn FROM r LEFT JOIN c ON r.seq = c.seq AND r.handle = c.handle),
tagged AS (SELECT one.handle, one.seq, CASE WHEN rn > 1 THEN 'duplicate' WHEN cn > 1 THEN 'collapsed_alias' WHEN a.i IS NOT NULL THEN 'stored_id' WHEN b.stored THEN 'stored_handle' WHEN b.out THEN 'excluded_file' END AS reason
  FROM one LEFT JOIN (SELECT i FROM sto WHERE stored AND i IS NOT NULL) a ON a.i = one.pid LEFT JOIN sto b ON b.h = one.handle)"""


def tagged_imports(t: Tables):
    out = t.raw("customer").filter("c_acctbal < 0").select(F.concat(F.lit("cust"), F.col("c_custkey")).alias("handle"))
    return graph.tag_imports(imports(t), stored_handles(t), out)


@query("grf4_delta_filter", with_sql(["links"], "SELECT handle, seq FROM tagged WHERE reason IS NULL", IMPORT))
def grf4(t: Tables):
    return tagged_imports(t).filter("reason IS NULL").select("handle", "seq")


@query("ag24_import_summary", with_sql(["links"], "SELECT coalesce(reason, 'imported') AS reason, count(*) AS n FROM tagged GROUP BY ROLLUP (coalesce(reason, 'imported'))", IMPORT))
def ag24(t: Tables):
    return graph.import_summary(tagged_imports(t))


@query("grf5_sparse_enrichment", with_sql(["profiles", "links"], """
SELECT profile_id, CASE WHEN rich THEN headline ELSE coalesce(headline, p.name) END AS display_name, CASE WHEN rich THEN company ELSE coalesce(company, p.description) END AS bio,
  NOT rich AND headline IS NULL AND p.name IS NOT NULL AS changed FROM (SELECT *, ordinal % 3 = 0 AS rich FROM profiles WHERE source = 'bonjour')
LEFT JOIN (SELECT dst AS handle, arg_min(name, seen_order) FILTER (name IS NOT NULL) AS name, arg_min(description, (-length(description), seen_order)) FILTER (description IS NOT NULL) AS description FROM links GROUP BY 1) p USING (handle)"""))
def grf5(t: Tables):
    existing = t.profiles().filter("source = 'bonjour'").select("profile_id", "handle", F.col("headline").alias("display_name"), F.col("company").alias("bio"),
                                                               F.lit(None).cast("string").alias("avatar"), (F.col("ordinal") % 3 == 0).alias("is_rich"))
    previews = friend_previews(t.links()).withColumn("avatar", F.lit(None).cast("string"))
    return graph.enrich_sparse(existing, previews).select("profile_id", "display_name", "bio", "changed")


@query("grf6_expansion_budget", with_sql(["opt_outs", "persons", "links"], """
SELECT handle, via, row_number() OVER (ORDER BY step, seq, handle) AS used FROM rows QUALIFY row_number() OVER (ORDER BY step, seq, handle) <= 40""", """
lead_rows AS (SELECT handle, 'lead' AS via, 0 AS step, CAST(substr(request_id, 2) AS BIGINT) AS seq FROM opt_outs WHERE status = 'pending' ORDER BY seq, handle LIMIT 40),
best AS (SELECT 'supp' || person_id AS src, row_number() OVER (ORDER BY confidence DESC, 'supp' || person_id) AS step FROM persons WHERE confidence > 0.5 AND 'supp' || person_id IN (SELECT src FROM links)),
near AS (SELECT dst AS handle, 'neighbour of ' || src AS via, step, k AS seq FROM (SELECT dst, b.src, step, row_number() OVER (PARTITION BY b.src ORDER BY seen_order, dst) AS k FROM links JOIN best b ON b.src = links.src WHERE step <= 5) WHERE k <= 10),
rows AS (SELECT * FROM lead_rows UNION ALL SELECT * FROM near)"""))
def grf6(t: Tables):
    leads = t.opt_outs().filter("status = 'pending'").select("handle", F.expr("cast(substr(request_id, 2) as bigint)").alias("seq"))
    seeds = t.persons().filter("confidence > 0.5").select(F.concat(F.lit("supp"), F.col("person_id")).alias("handle"), "confidence")
    edges = t.links().select("src", "dst", F.col("seen_order").alias("seq"))
    held = edges.select(F.col("src").alias("handle")).distinct()
    return graph.expansion_targets(leads, seeds.join(held, "handle", "left_semi"), edges, budget=40).select("handle", "via", "used")


@query("sig1_signal_report", with_sql(["profiles", "post_refs"], """
SELECT handle, list_filter([CASE WHEN o2 OR c2 THEN 'nation5' END, CASE WHEN o1 OR c1 THEN 'urgent' END], lambda x: x IS NOT NULL) AS signals,
  list_filter([CASE WHEN o1 OR o2 THEN 'profile' END, CASE WHEN c1 OR c2 THEN 'community_context' END], lambda x: x IS NOT NULL) AS hit_sources, coalesce(posts, 0) AS posts FROM (
SELECT handle, FALSE AS o1, regexp_matches(bio, '(^|[^a-z0-9])nation_5([^a-z0-9]|$)') AS o2, coalesce(regexp_matches(lower(ctx), '(^|[^a-z0-9])urgent([^a-z0-9]|$)'), FALSE) AS c1, FALSE AS c2, posts
FROM profiles LEFT JOIN (SELECT handle, string_agg(DISTINCT category_title, chr(10)) AS ctx, count(*) AS posts FROM post_refs GROUP BY 1) USING (handle)) WHERE o1 OR o2 OR c1 OR c2"""))
def sig1(t: Tables):
    context = t.post_refs().groupBy("handle").agg(F.array_join(F.sort_array(F.collect_set("category_title")), "\n").alias("context_text"), F.count(F.lit(1)).alias("posts"))
    own = t.profiles().select("handle", F.col("bio").alias("own_text"))
    return graph.signal_report(own, context, {"urgent": ["urgent"], "nation5": ["nation_5"]})
