"""Ingest job: raw payloads to stored profiles, persons, evidence and search documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..config import DEFAULT, Config
from ..operators import evidence as ev
from ..operators import identity, index, normalize
from ..operators.common import visible_profiles
from ..operators.joins import source_hints
from ..sources.sinks import KeyedTable, append_new_evidence, merge_profiles, upsert_profiles


def store_profiles(existing: DataFrame, raw: DataFrame, source: str, opt_outs: DataFrame, now) -> DataFrame:
    """Normalise one source's raw payloads (row_id gives arrival order) and merge them into the stored table.

    ``existing`` has the columns of the result; opted-out handles land hidden.
    """
    rows = normalize.NORMALISERS[source](raw).withColumn("seq", F.col("row_id").cast("long")).drop("row_id")
    return upsert_profiles(existing, rows, opt_outs, now)


def store_profiles_in(table: KeyedTable, raw: DataFrame, source: str, opt_outs: DataFrame, now) -> list[int]:
    """``store_profiles`` on a table keyed by profile_id, rewriting the touched partitions only."""
    rows = normalize.NORMALISERS[source](raw).withColumn("seq", F.col("row_id").cast("long"))
    return merge_profiles(table, rows.select(*[c for c in table.schema.names if c in rows.columns], "seq"), opt_outs, now)


def resolve_people(stored: DataFrame, identities: DataFrame, opt_outs: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Match the visible unlinked profiles of both sources; returns the parts of ``identity.resolve`` and the new links."""
    shown = visible_profiles(stored, opt_outs)
    orgs = F.transform(F.filter("aliases", lambda a: a["type"] == "other"), lambda a: a["value"])
    named = F.transform(F.filter("aliases", lambda a: a["type"] == V.CODE_SOURCE), lambda a: F.lower(a["value"]))
    rows = shown.withColumns({"companies": orgs, "linked_handles": named, "ordinal": F.xxhash64("profile_id")})
    out = identity.resolve(rows.filter(F.col("source") == V.PROFILE_SOURCE), rows.filter(F.col("source") == V.CODE_SOURCE), identities, cfg.identity)
    return {**out, "links": identity.new_links(out, cfg.identity)}


def collect_evidence(persons: DataFrame, identities: DataFrame, stored: DataFrame, existing: DataFrame, opt_outs: DataFrame, now,
                     posts: DataFrame | None = None):
    """New evidence of active persons (to append), with the job signals of their posts, and the payloads that could not be read."""
    items, errors = ev.extract_all(persons, identities, visible_profiles(stored, opt_outs), posts)
    rows = items.withColumns({"evidence_id": F.sha2(F.concat_ws("|", F.col("person_id").cast("string"), "source", "evidence_hash"), 256),
                              "created_at": F.lit(now).cast("timestamp")})
    return append_new_evidence(existing, rows), errors


def index_people(persons: DataFrame, evidence: DataFrame, identities: DataFrame, stored: DataFrame, seeds: DataFrame, opt_outs: DataFrame,
                 now, targets: DataFrame | None = None, **options) -> DataFrame:
    """Search documents of all active persons, or of the target persons only."""
    people = index.rebuild_targets(persons, targets)
    own = evidence.join(people.select("person_id"), "person_id", "left_semi")
    hints = source_hints(identities, visible_profiles(stored, opt_outs))
    places = own.filter("field = 'location'").select("person_id", F.col("description").alias("place"))
    return index.build_documents(people, own, hints, seeds, places, now, **options)
