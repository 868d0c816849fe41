"""Duplicate persons through strong aliases: canonical aliases, edges, components, merge."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import name_key
from ..functions.text import trim_ws
from ..session import cut_lineage
from .common import best_row
from .identity import head_piece, text_pieces
from .windows import component_winners

# Host prefixes and handle patterns of the strong alias types.
ALIAS_HOSTS = {"github": "github.com", "x": "x.com|twitter.com"}
ALIAS_PATTERNS = {"github": r"^([a-z\d](?:[a-z\d-]{0,38}))$", "x": r"^([a-z\d_]{1,15})$"}


def canonical_alias(kind: Column, value: Column) -> Column:
    """Lower handle of a github / x / jike alias; null when the type or the handle is not acceptable.

    One regex takes the first path segment behind a URL or a known host, or the whole value otherwise,
    each without a leading @; a second one keeps it only when it is a legal handle.
    """
    low = F.lower(trim_ws(value))
    out = F.when(kind == "jike", F.nullif(F.regexp_replace(low, "^@", ""), F.lit("")))
    for name, hosts in ALIAS_HOSTS.items():
        host = hosts.replace(".", r"\.")
        handle = F.regexp_replace(low, rf"^(?:(?:[a-z][a-z0-9+.\-]*://[^/?#]*/*|(?:{host})/)@?([^/?#]*).*|@?(.*))$", "$1$2")
        out = out.when(kind == name, F.nullif(F.regexp_extract(handle, ALIAS_PATTERNS[name], 1), F.lit("")))
    return out


def strong_aliases(rows: DataFrame) -> DataFrame:
    """(person_id, alias_type, alias_value, confidence) -> distinct canonical aliases of confidence 1."""
    kept = rows.filter(F.col("confidence") >= 1).withColumn("alias", canonical_alias(F.col("alias_type"), F.col("alias_value")))
    return kept.filter("alias IS NOT NULL").select("person_id", F.concat_ws(":", "alias_type", "alias").alias("alias_key"),
                                                   "alias_type").distinct()


def alias_edges(aliases: DataFrame, persons: DataFrame) -> DataFrame:
    """Edges (src, dst) whose components equal those of all qualifying pairs inside alias groups.

    A pair qualifies when the names are equal (spaces ignored), one contains the other, or the locations
    are equal. Equality is transitive, so every member is linked to the smallest member with the same key
    instead of to every other member; containment links the smallest holders of the two names.
    """
    rows = aliases.join(persons.select("person_id", "name", "location"), "person_id").select(
        "alias_key", "person_id", F.lower(trim_ws("name")).alias("name"), name_key("name").alias("name_key"),
        F.lower(trim_ws("location")).alias("place"))

    def star(key):
        held = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
        heads = held.groupBy("alias_key", key).agg(F.min("person_id").alias("dst"))
        return held.join(heads, ["alias_key", key]).filter("person_id <> dst").select(F.col("person_id").alias("src"), "dst")

    names = rows.filter(F.coalesce("name", F.lit("")) != "").groupBy("alias_key", "name").agg(F.min("person_id").alias("head"))
    several = names.groupBy("alias_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("alias_key")
    names = names.join(several, "alias_key", "left_semi")
    parts = names.select("alias_key", F.col("head").alias("src"), F.col("name").alias("outer"), F.explode(text_pieces(F.col("name"))).alias("piece"))
    held = names.select("alias_key", "name", F.col("head").alias("dst"), head_piece(F.col("name")).alias("piece"))
    inside = parts.join(held, ["alias_key", "piece"]).filter(F.contains("outer", F.col("name")) & (F.col("outer") != F.col("name"))).select("src", "dst")
    return star("place").unionByName(star("name_key")).unionByName(inside.filter("src <> dst")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node id.

    Each round takes the smallest label among neighbours and then follows labels of labels, so paths halve
    and the number of rounds grows with the logarithm of the diameter. Labels are stored every round.
    """
    both = cut_lineage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    for _ in range(max_rounds):
        offers = both.join(labels.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.min("component").alias("offer"))
        lowered = labels.join(offers, "node").select("node", "component", F.least("component", "offer").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        stepped = cut_lineage(lowered.join(hop, "low").select("node", F.least("low", "next").alias("low"), F.col("component").alias("old")))
        labels = stepped.select("node", F.col("low").alias("component"))
        if stepped.filter("low <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def choose_winners(components: DataFrame, persons: DataFrame, identities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(node, component, winner) using identity count, evidence count, age and id."""
    members = components.select(F.col("node").alias("person_id"), "component")
    i = identities.join(members.select("person_id"), "person_id", "left_semi").groupBy("person_id").agg(F.count(F.lit(1)).alias("identities"))
    e = evidence.join(members.select("person_id"), "person_id", "left_semi").groupBy("person_id").agg(F.count(F.lit(1)).alias("evidence"))
    stats = (members.join(persons.select("person_id", "created_at"), "person_id").join(i, "person_id", "left").join(e, "person_id", "left")
             .select("component", "person_id", F.coalesce("identities", F.lit(0)).alias("identities"),
                     F.coalesce("evidence", F.lit(0)).alias("evidence"), "created_at"))
    return members.join(component_winners(stats).select("component", "winner"), "component")


def merge_reasons(winners: DataFrame, aliases: DataFrame, persons: DataFrame) -> DataFrame:
    """(person_id, winner, signals): alias types the loser shares directly with its winner in a qualifying pair.

    Only loser-winner pairs are looked at, never all pairs of a component.
    """
    losers = winners.filter("person_id <> winner").select("person_id", "winner")
    names = persons.select("person_id", F.lower(trim_ws("name")).alias("name"), name_key("name").alias("name_key"), F.lower(trim_ws("location")).alias("place"))
    j = losers.join(aliases, "person_id").join(aliases.select(F.col("person_id").alias("winner"), "alias_key"), ["winner", "alias_key"])
    w = names.select(*[F.col(c).alias("winner" if c == "person_id" else f"w_{c}") for c in names.columns])
    j = j.join(names, "person_id").join(w, "winner")
    def filled(c):
        return F.coalesce(F.col(c), F.lit("")) != ""
    named = filled("name") & filled("w_name") & ((F.col("name_key") == F.col("w_name_key")) | F.contains("name", F.col("w_name")) | F.contains("w_name", F.col("name")))
    ok = j.filter(named | (filled("place") & (F.col("place") == F.col("w_place"))))
    signals = ok.groupBy("person_id", "winner").agg(F.sort_array(F.collect_set(F.concat(F.lit("strong_alias_"), F.col("alias_type")))).alias("signals"))
    return losers.join(signals, ["person_id", "winner"], "left").withColumn(
        "signals", F.coalesce("signals", F.array(F.lit("strong_alias_dedupe"))))


def merge_persons(winners: DataFrame, persons: DataFrame, identities: DataFrame, docs: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """Identities re-pointed to the winners; losers removed; documents and vectors of all members dropped for re-indexing."""
    remap = winners.select("person_id", "winner")
    losers = winners.filter("person_id <> winner").select("person_id")
    moved = identities.join(remap, "person_id", "left").withColumn("person_id", F.coalesce("winner", "person_id")).drop("winner")
    touched = winners.select("person_id")
    return {"identities": best_row(moved, ["profile_id"], F.col("match_score")),
            "persons": persons.join(losers, "person_id", "left_anti"),
            "docs": docs.join(touched, "person_id", "left_anti"), "embeddings": embeddings.join(touched, "person_id", "left_anti"),
            "reindex": winners.select(F.col("winner").alias("person_id")).distinct()}
