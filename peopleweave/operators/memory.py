"""User memories, inferred preferences, result cache, claims, opt-outs and work items."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, MemoryConfig
from ..functions.arrays import or_empty
from ..functions.dates import at
from ..functions.text import word_hits
from .aggregates import negative_patterns
from .common import best_row, latest_wins, top_k


def alive(now):
    return F.col("expires_at").isNull() | (F.col("expires_at") > at(now))


def list_memories(memories: DataFrame, now, kind=None, scope_kind=None, scope_value=None, source=None,
                  include_expired: bool = False, limit: int | None = None) -> DataFrame:
    """Per user, newest first when limited. A scope without a value means the global (null) one."""
    m = memories
    if kind:
        m = m.filter(F.col("kind") == kind)
    if source:
        m = m.filter(F.col("source") == source)
    if scope_kind:
        m = m.filter((F.col("scope_kind") == scope_kind) & F.col("scope_value").eqNullSafe(F.lit(scope_value)))
    if not include_expired:
        m = m.filter(alive(now))
    return m if limit is None else top_k(m, ["user_id"], [F.desc("updated_at"), "memory_id"], limit)


def purge_expired(memories: DataFrame, now) -> DataFrame:
    """Rows kept; a row expiring exactly now is not older than now and stays."""
    return memories.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= at(now)))


def hydrate(memories: DataFrame, now, heads: int | None = None) -> DataFrame:
    """Live memories split in four groups per user, as sizes and the ids of each, newest first; ``heads`` keeps so many.

    A row holds the ids of one user. For users with more memories than a row should hold, take the long form,
    ``grouped_memories``, or set ``heads``.
    """
    g = grouped_memories(memories, now)
    counts = g.groupBy("user_id").agg(*[F.count_if(F.col("memory_group") == n).alias(n) for n in GROUPS])
    ranked = top_k(g, ["user_id", "memory_group"], [F.desc("updated_at"), "memory_id"], heads, "slot")
    lists = ranked.groupBy("user_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(
        F.col("memory_group") == n, F.struct("slot", "memory_id")))), lambda x: x["memory_id"]).alias(f"{n}_ids") for n in GROUPS])
    return counts.join(lists, "user_id")


GROUPS = ["explicit", "inferred", "feedback", "hiring"]


def grouped_memories(memories: DataFrame, now) -> DataFrame:
    k, s = F.col("kind"), F.col("source")
    group = (F.when((k == "preference") & (s == "explicit"), "explicit").when((k == "preference") & (s == "inferred"), "inferred")
             .when(k == "feedback", "feedback").when(k == "hiring_context", "hiring"))
    return memories.filter(alive(now)).withColumn("memory_group", group).filter("memory_group IS NOT NULL")


def infer_preferences(feedback: DataFrame, memories: DataFrame, now, cfg: MemoryConfig = DEFAULT.memory) -> DataFrame:
    """New inferred preferences from repeated negative feedback, unless an explicit one has the same key or it exists."""
    table = F.create_map(*[F.lit(x) for pair in V.REASON_TO_PREFERENCE.items() for x in pair])
    found = negative_patterns(feedback, now, cfg.min_count, cfg.window_days).withColumn("preference_key", F.try_element_at(table, F.col("reason_code")))
    prefs = memories.filter((F.col("kind") == "preference") & F.col("preference_key").isNotNull() & alive(now)).select(
        "user_id", "preference_key").distinct()
    fresh = found.filter("preference_key IS NOT NULL").join(prefs, ["user_id", "preference_key"], "left_anti")
    return fresh.select("user_id", "preference_key", "n", F.lit("inferred").alias("source"), F.lit(cfg.inferred_confidence).alias("confidence"),
                        (at(now) + F.expr(f"interval {cfg.inferred_expiry_days} days")).alias("expires_at"))


def preferences_from_text(texts: DataFrame, technologies=V.PREFERENCE_TECH, cities=V.PREFERENCE_CITIES, roles=V.PREFERENCE_ROLES) -> DataFrame:
    """Preference candidates named in free text (column ``text``)."""
    low, raw = F.lower("text"), F.col("text")
    spoken = F.transform(F.regexp_extract_all(raw, F.lit(r"(?:会|懂|熟悉|擅长)\s*([a-zA-Z+#]+)"), F.lit(1)), F.lower)
    role = F.coalesce(*[F.when(raw.rlike(f"(?i){p}"), F.lit(r)) for r, p in roles])
    source = F.when(low.contains(V.PROFILE_SOURCE), V.PROFILE_SOURCE).when(low.contains(V.CODE_SOURCE), V.CODE_SOURCE)
    fresh = F.lit(False)
    for phrase in V.PREFERENCE_FRESH:
        fresh = fresh | low.contains(phrase)
    return texts.select(*texts.columns, F.array_distinct(F.concat(word_hits(low, technologies), spoken)).alias("tech_stack"),
                        word_hits(raw, cities).alias("locations"), role.alias("role"), source.alias("source_bias"), fresh.alias("prefer_fresh"))


def seed_conditions(memories: DataFrame, now) -> DataFrame:
    """Start conditions per user from live explicit preferences: unions of lists, first scalar in newest-first order."""
    m = memories.filter((F.col("kind") == "preference") & (F.col("source") == "explicit") & alive(now))
    order = F.struct((-F.unix_micros("updated_at")).alias("t"), "memory_id")
    lists = m.select("user_id", F.explode(F.concat(
        F.transform(or_empty("tech_stack"), lambda v: F.struct(F.lit("skills").alias("k"), v.alias("v"))),
        F.transform(or_empty("locations"), lambda v: F.struct(F.lit("locations").alias("k"), v.alias("v"))))).alias("x")).distinct()
    sets = lists.groupBy("user_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("x.k") == n, F.col("x.v")))).alias(n) for n in ("skills", "locations")])
    scalars = m.groupBy("user_id").agg(F.min_by("role", F.when(F.col("role").isNotNull(), order)).alias("role"))
    return scalars.join(sets, "user_id", "left").select("user_id", or_empty("skills").alias("skills"), or_empty("locations").alias("locations"), "role")


def cache_lookup(cache: DataFrame, wanted: DataFrame, now) -> DataFrame:
    return wanted.join(cache.filter(F.col("expires_at") > at(now)), ["person_id", "query_key"])


def cache_store(cache: DataFrame, entries: DataFrame, now, cfg: MemoryConfig = DEFAULT.memory) -> DataFrame:
    """Merge new entries (person_id, query_key, payload) and drop expired ones."""
    stamp = at(now)
    new = entries.select("person_id", "query_key", "payload", stamp.alias("cached_at"), (stamp + F.expr(f"interval {cfg.cache_ttl_days} days")).alias("expires_at"))
    return latest_wins(cache.filter(F.col("expires_at") > stamp), new, ["person_id", "query_key"], F.struct("cached_at", "payload"))


def cache_invalidate(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (person_id, query_key); a null key drops every entry of the person."""
    whole = requests.filter("query_key IS NULL").select("person_id").distinct()
    one = requests.filter("query_key IS NOT NULL").select("person_id", "query_key").distinct()
    return cache.join(whole, "person_id", "left_anti").join(one, ["person_id", "query_key"], "left_anti")


def feedback_history(feedback: DataFrame, sentiment=None, since=None, limit: int | None = None) -> DataFrame:
    f = feedback
    if sentiment:
        f = f.filter(F.col("sentiment") == sentiment)
    if since:
        f = f.filter(F.col("created_at") > at(since))
    return f if limit is None else top_k(f, ["user_id"], [F.desc("created_at"), "feedback_id"], limit)


def forget(memories: DataFrame, requests: DataFrame, preferences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept memories, deleted count per request). A null scope value is the global scope.

    Users who paused memory keep their rows untouched and see none of them.
    """
    req = requests.select("user_id", "scope_kind", "scope_value").distinct()
    active = memories.join(preferences.filter("memory_paused").select("user_id"), "user_id", "left_anti")
    hit = ((F.col("m.user_id") == F.col("r.user_id")) & (F.col("m.scope_kind") == F.col("r.scope_kind"))
           & F.col("m.scope_value").eqNullSafe(F.col("r.scope_value")))
    gone = active.alias("m").join(req.alias("r"), hit, "left_semi")
    counts = gone.groupBy("user_id", "scope_kind", "scope_value").agg(F.count(F.lit(1)).alias("n_deleted"))
    kept = active.alias("m").join(req.alias("r"), hit, "left_anti")
    return kept, counts


# --- claims, owner edits, opt-outs, work items ---------------------------------------------------
def claim_states(claims: DataFrame) -> DataFrame:
    """Latest approved claim per person, how many approvals there are, and whether that breaks the one-claim rule."""
    ok = claims.filter("status = 'approved'")
    first = best_row(ok.select("person_id", "claim_id", "verified_at"), ["person_id"], F.struct("verified_at", "claim_id"), maximum=False)
    n = ok.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_approved"))
    return first.join(n, "person_id").withColumn("violation", F.col("n_approved") > 1)


def accept_claims(claims: DataFrame, requests: DataFrame, persons: DataFrame) -> DataFrame:
    """Decision per request (request_id, person_id, method, seq): unknown person, already claimed, or accepted once per person."""
    taken = claims.filter("status = 'approved'").select("person_id").distinct().withColumn("_t", F.lit(True))
    known = persons.select("person_id").withColumn("_k", F.lit(True))
    j = requests.join(known, "person_id", "left").join(taken, "person_id", "left")
    valid = F.col("method").isin("email", "github") & F.col("_k") & F.col("_t").isNull()
    first = j.filter(valid).groupBy("person_id").agg(F.min("seq").alias("_first"))
    j = j.join(first, "person_id", "left")
    decision = (F.when(~F.col("method").isin("email", "github"), "invalid_method").when(F.col("_k").isNull(), "unknown_person")
                .when(F.col("_t"), "already_claimed").when(F.col("seq") == F.col("_first"), "accepted").otherwise("already_claimed"))
    return j.select("request_id", "person_id", decision.alias("decision"))


def apply_owner_changes(changes: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome per change (change_id, person_id, action, evidence_id, evidence_type): applied or the reason it is not."""
    claimed = claims.filter("status = 'approved'").select("person_id").distinct().withColumn("_c", F.lit(True))
    owners = evidence.select("evidence_id", F.col("person_id").alias("_owner")).join(changes.select("evidence_id").distinct(), "evidence_id", "left_semi")
    j = changes.join(claimed, "person_id", "left").join(owners, "evidence_id", "left")
    act = F.col("action")
    outcome = (F.when(F.col("_c").isNull(), "not_claimed").when((act == "delete_evidence") & F.col("_owner").isNull(), "not_found")
               .when((act == "delete_evidence") & (F.col("_owner") != F.col("person_id")), "not_owner")
               .when((act == "add_evidence") & ~F.coalesce(F.col("evidence_type").isin(V.EVIDENCE_TYPES), F.lit(False)), "invalid_type")
               .otherwise("applied"))
    return j.select("change_id", "person_id", "action", "evidence_id", outcome.alias("outcome"))


def evidence_after_changes(evidence: DataFrame, outcomes: DataFrame) -> DataFrame:
    gone = outcomes.filter("outcome = 'applied' AND action = 'delete_evidence'").select("evidence_id").distinct()
    return evidence.join(gone, "evidence_id", "left_anti")


def process_opt_outs(profiles: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles with matching ones hidden, hidden count per request)."""
    handles = requests.select("source", "handle").distinct().withColumn("_h", F.lit(True))
    hidden = profiles.join(handles, ["source", "handle"], "left").withColumn(
        "is_deleted", F.col("is_deleted") | F.coalesce("_h", F.lit(False))).drop("_h")
    counts = requests.join(profiles.select("source", "handle", "profile_id"), ["source", "handle"], "left").groupBy("request_id").agg(
        F.count("profile_id").alias("n_hidden"))
    return hidden, counts


def searchable_persons(persons: DataFrame, identities: DataFrame, profiles: DataFrame, opt_outs: DataFrame) -> DataFrame:
    """Persons with at least one profile that is neither deleted nor opted out; persons without profiles stay."""
    out = opt_outs.filter("status = 'processed'").select("source", "handle").distinct().withColumn("_o", F.lit(True))
    p = profiles.join(out, ["source", "handle"], "left").select("profile_id", (~F.col("is_deleted") & F.col("_o").isNull()).alias("_ok"))
    per = identities.join(p, "profile_id").groupBy("person_id").agg(F.max("_ok").alias("_ok"))
    return persons.join(per, "person_id", "left").filter(F.coalesce("_ok", F.lit(True))).drop("_ok")


def work_items(items: DataFrame, status=None, limit: int | None = None) -> DataFrame:
    rows = items if status is None else items.filter(F.col("status") == status)
    return rows if limit is None else top_k(rows, ["user_id"], [F.desc("updated_at"), "item_id"], limit)


def recent_sessions(sessions: DataFrame, limit: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(limit)


