"""Sinks: keyed upserts, hash-partitioned tables, the run ledger, exports and snapshot packs.

Upserts are pure DataFrame functions giving new table contents. ``KeyedTable`` applies them to the partitions that a batch touches and to no others.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.similarity import percent
from ..functions.text import trim_ws
from ..operators.common import best_row, insert_if_absent, latest_wins
from ..session import stored


SALTS = 64  # parts that the rows of one partition are dealt into when they are appended


@dataclass(frozen=True)
class KeyedTable:
    """A folder of plain Parquet, partitioned by a hash of the key columns; a row with a key lies in one known partition.

    A merge joins its batch with the touched partitions only and lets Spark overwrite just these; the files of all others stay as they are.
    Spark moves the partitions in one after the other when the job commits, so after a crash the same batch has to be merged again, which is
    harmless with merges that keep the newest or the first row of a key. One writer at a time. ``partitions`` belongs to the folder and is never changed.
    """
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType
    partitions: int = 64

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int"))

    def _write(self, placed: DataFrame) -> None:
        rows = placed.select(*self.schema.names, "_part").repartition("_part")
        rows.write.partitionBy("_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some partitions: other folders are not listed as input."""
        df = self.spark.read.schema(StructType([*self.schema.fields, StructField("_part", IntegerType())])).parquet(self.path)
        return (df if parts is None else df.filter(F.col("_part").isin(parts))).drop("_part")

    def create(self, df: DataFrame) -> None:
        """First contents. An empty table still gets its folder."""
        self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("_part", IntegerType())])).write.mode("append").partitionBy("_part").parquet(self.path)
        self._write(self._placed(df))

    def _touched(self, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        batch = stored(self._placed(batch), "batch")
        return batch.drop("_part"), sorted(r[0] for r in batch.select("_part").distinct().collect())

    def merge(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched partitions by ``merge(their rows, batch)`` and return their numbers, at most ``partitions`` of them.

        ``merge`` may change or add rows of keys of the batch only.
        """
        batch, touched = self._touched(batch)
        if touched:
            self._write(self._placed(merge(self.read(touched), batch)))
        return touched

    def add(self, batch: DataFrame, absent: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> list[int]:
        """Append ``absent(rows of the touched partitions, batch, columns to place rows by)``; stored files stay as they are.

        For merges that change no stored row; a repeated batch adds nothing. Rows of a partition are dealt to several tasks, each of which adds a file.
        """
        batch, touched = self._touched(batch)
        if touched:
            place = lambda df: self._placed(df).withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(SALTS)).cast("int"))
            fresh = absent(place(self.read(touched)), place(batch), ["_part", "_salt"])
            fresh.select(*self.schema.names, "_part").write.mode("append").partitionBy("_part").parquet(self.path)
        return touched


def keyed_table(df: DataFrame, path: str, keys, partitions: int = 64) -> KeyedTable:
    """Write ``df`` as a new table."""
    table = KeyedTable(df.sparkSession, path, tuple(keys), StructType([StructField(f.name, f.dataType) for f in df.schema.fields]), partitions)
    table.create(df)
    return table


def identify_profiles(existing: DataFrame, incoming: DataFrame, opt_outs: DataFrame, now) -> DataFrame:
    """Incoming rows with the profile_id they belong to: that of (source, source_profile_id), else of (source, handle), else a new one.

    Of ``existing`` only profile_id, source, source_profile_id and handle are read. Handles with a processed opt-out come out hidden.
    """
    stamp = F.lit(now).cast("timestamp")
    hidden = opt_outs.filter("status = 'processed'").select("source", "handle").distinct().withColumn("_out", F.lit(True))
    # A handle first seen without an id and later with one is the same new row.
    in_batch = incoming.groupBy("source", "handle").agg(F.min("source_profile_id").alias("_batch_id"))
    by_id = existing.filter("source_profile_id IS NOT NULL").select(
        "source", "source_profile_id", F.col("profile_id").alias("_by_id"))
    by_handle = existing.select("source", "handle", F.col("profile_id").alias("_by_handle"))
    keyed = (incoming.drop("profile_id", "is_deleted", "synced_at", "seen_at")
             .join(by_id, ["source", "source_profile_id"], "left").join(by_handle, ["source", "handle"], "left")
             .join(in_batch, ["source", "handle"], "left").join(hidden, ["source", "handle"], "left"))
    new_id = F.sha2(F.concat_ws("|", "source", F.coalesce("source_profile_id", "_batch_id", "handle")), 256)
    return keyed.select(F.coalesce("_by_id", "_by_handle", new_id).alias("profile_id"),
                        *[c for c in incoming.columns if c not in ("profile_id", "is_deleted", "synced_at", "seen_at")],
                        F.coalesce("_out", F.lit(False)).alias("is_deleted"), stamp.alias("synced_at"),
                        stamp.alias("seen_at"))


def _last_arrival(existing: DataFrame, keyed: DataFrame) -> DataFrame:
    return latest_wins(existing.withColumn("seq", F.lit(None).cast("long")), keyed, ["profile_id"], "seq").drop("seq")


def upsert_profiles(existing: DataFrame, incoming: DataFrame, opt_outs: DataFrame, now) -> DataFrame:
    """Match on (source, source_profile_id) first, else on (source, handle); last incoming row wins.

    Handles with a processed opt-out land hidden. ``incoming`` carries ``seq``, the arrival order.
    """
    return _last_arrival(existing, identify_profiles(existing, incoming, opt_outs, now))


def merge_profiles(table: KeyedTable, incoming: DataFrame, opt_outs: DataFrame, now) -> list[int]:
    """``upsert_profiles`` on a table keyed by profile_id: the narrow key columns are read in full, whole rows only from touched partitions.

    ``incoming`` is worked out once and stored, since its rows are read twice: whole, and by handle.
    """
    incoming = stored(incoming, "incoming")
    return table.merge(identify_profiles(table.read(), incoming, opt_outs, now), _last_arrival)


def merge_by_person(table: KeyedTable, incoming: DataFrame, stamp: str) -> list[int]:
    return table.merge(incoming, lambda old, new: upsert_by_person(old, new, stamp))


def merge_absent(table: KeyedTable, incoming: DataFrame, absent: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Add the rows of a batch whose key is not stored; ``absent`` is ``append_new_evidence`` or ``append_new_aliases``."""
    return table.add(incoming, absent)


def merge_identities(table: KeyedTable, incoming: DataFrame) -> list[int]:
    return table.merge(incoming, replace_identities)


def upsert_by_person(existing: DataFrame, incoming: DataFrame, stamp: str) -> DataFrame:
    """Documents or embeddings: one row per person, newest write wins."""
    return latest_wins(existing, incoming, ["person_id"], stamp)


def append_new_evidence(existing: DataFrame, incoming: DataFrame, place=()) -> DataFrame:
    return insert_if_absent(existing, incoming, ["person_id", "source", "evidence_hash"],
                            F.struct("created_at", "evidence_id"), place)


def append_new_aliases(existing: DataFrame, incoming: DataFrame, place=()) -> DataFrame:
    return insert_if_absent(existing, incoming, ["person_id", "alias_type", "alias_value"], F.col("seq"), place)


def replace_identities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One person per profile: a newer edge re-points the profile."""
    return latest_wins(existing.withColumn("seq", F.lit(None).cast("long")), incoming, ["profile_id"], "seq").drop("seq")


# --- run ledger -------------------------------------------------------------------------
LEDGER_SCHEMA = ("run_id string, source string, job string, status string, processed long, errors long, "
                 "next_cursor long, started_at timestamp, finished_at timestamp")


def run_status(processed: Column, errors: Column) -> Column:
    return F.when(errors == 0, "succeeded").when(processed > 0, "partial").otherwise("failed")


def complete_runs(work: DataFrame, now) -> DataFrame:
    """One ledger row per run from its per-item outcomes.

    work: (run_id, source, job, item, ok, started_at); next_cursor is set while items remain undone.
    """
    counts = work.groupBy("run_id", "source", "job").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("errors"),
        F.min("started_at").alias("started_at"))
    return counts.select("run_id", "source", "job", run_status(F.col("processed"), F.col("errors")).alias("status"),
                         "processed", "errors",
                         F.when(F.col("processed") < F.col("total"), F.col("processed")).alias("next_cursor"),
                         "started_at", F.lit(now).cast("timestamp").alias("finished_at"))


def latest_runs(ledger: DataFrame, limit: int = 10) -> DataFrame:
    return ledger.orderBy(F.desc("started_at"), "run_id").limit(limit)


# --- exports -----------------------------------------------------------------------------
def _sources(record_source: Column) -> Column:
    return F.filter(F.transform(F.split(record_source, ","), trim_ws), lambda s: s != "")


# Column order and labels of the exported shortlist.
CSV_COLUMNS = ["shortlistIndex", "name", "headline", "location", "company", "matchScore", "source", "freshness",
               "bonjourUrl", "whyMatched", "goalFit", "evidenceStrength", "sourceQualityRecency", "uncertainty",
               "recommendationOutcome", "confidence", "decisionTag", "recommendation", "nextStep", "topEvidence"]
STALE = "(未知|月前|年前)"


def _percent_or_raw(score: Column) -> Column:
    return F.when(score <= 1, score * 100).otherwise(score)


def export_confidence(gap: Column, evidence_count: Column, source_count: Column, freshness: Column) -> Column:
    """Null gap means there is no runner-up to compare with."""
    fresh = ~freshness.rlike(STALE)
    high = (gap >= 8) & (evidence_count >= 2) & (source_count >= 2) & fresh
    medium = gap.isNotNull() & (evidence_count >= 1) & ((gap >= 4) | (source_count >= 2) | fresh)
    return F.when(high, "高信心").when(medium, "中信心").otherwise("低信心")


def outcome_of(confidence: Column) -> Column:
    return F.when(confidence == "高信心", "明确推荐").when(confidence == "中信心", "条件式推荐").otherwise("暂不推荐")


def export_records(records: DataFrame) -> DataFrame:
    """Shortlist rows with the presentation columns of the export.

    records: (shortlistIndex, name, headline, location, company, match_score, source, freshness, bonjourUrl,
    whyMatched, decisionTag, recommendation, nextStep, top_evidence array<struct<source,type,title,freshness>>)
    """
    n_evidence, n_sources = F.size("top_evidence"), F.size(_sources(F.col("source")))
    pct = _percent_or_raw(F.col("match_score"))
    level = F.when(pct >= 80, "强").when(pct >= 65, "中").otherwise("弱")
    strength = (F.when((n_evidence >= 2) & (n_sources >= 2) & ~F.col("freshness").rlike(STALE), "强")
                .when(n_evidence >= 1, "中").otherwise("弱"))
    doubt = (F.when(n_evidence == 0, "缺少可追溯的核心证据").when(n_sources < 2, "主要依赖单一来源")
             .when(F.col("freshness").rlike(STALE), "近期信号偏旧或时效未知").otherwise("仍建议查看详情页确认上下文"))
    confidence = export_confidence(F.lit(None).cast("double"), n_evidence, n_sources, F.col("freshness"))
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in records.columns if c != "top_evidence"}
    listed = F.array_join(F.transform("top_evidence", lambda e: F.concat(
        F.lit("["), e["source"], F.lit("/"), e["type"], F.lit("] "), e["title"],
        F.when(e["freshness"].isNotNull(), F.concat(F.lit(" ("), e["freshness"], F.lit(")"))).otherwise(""))), " | ")
    return records.select(
        blank["shortlistIndex"].alias("shortlistIndex"), "name", blank["headline"].alias("headline"),
        blank["location"].alias("location"), blank["company"].alias("company"),
        F.concat(F.round(percent("match_score"), 0).cast("long").cast("string"), F.lit("%")).alias("matchScore"),
        "source", "freshness", blank["bonjourUrl"].alias("bonjourUrl"), "whyMatched",
        F.concat(level, F.lit(" · "), F.col("whyMatched")).alias("goalFit"),
        F.concat(strength, F.lit(" · "), n_evidence.cast("string"), F.lit(" 条核心证据")).alias("evidenceStrength"),
        F.concat(F.when(F.col("source") == "", "来源未知").otherwise(F.col("source")), F.lit(" · "), F.col("freshness"))
        .alias("sourceQualityRecency"), doubt.alias("uncertainty"), outcome_of(confidence).alias("recommendationOutcome"),
        confidence.alias("confidence"), blank["decisionTag"].alias("decisionTag"),
        blank["recommendation"].alias("recommendation"), blank["nextStep"].alias("nextStep"),
        listed.alias("topEvidence"))


def csv_field(value: Column) -> Column:
    """Quote only when the text holds a comma, quote or line break; quotes are doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def csv_lines(df: DataFrame, columns=None) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in (columns or df.columns)]).alias("line"))


def write_csv_export(df: DataFrame, path: str, columns=None) -> None:
    """Parallel write; each part file starts with the header, as Spark's own CSV writer does."""
    (df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def write_json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_sections(exported: DataFrame) -> DataFrame:
    """One Markdown section per exported row, keyed by its index for ordered writing."""
    def line(label, name, missing="未知"):
        return F.concat(F.lit(f"- {label}: "), F.when(F.col(name) == "", missing).otherwise(F.col(name)))

    def optional(label, name):
        return F.when(F.col(name) != "", F.concat(F.lit(f"- {label}: "), F.col(name)))

    return exported.select("shortlistIndex", F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col("shortlistIndex"), F.lit(". "), F.col("name")), F.lit(""),
        line("Headline", "headline"), line("Location", "location"), line("Company", "company"),
        line("Score", "matchScore"), line("Source", "source"), line("Freshness", "freshness"),
        line("Bonjour", "bonjourUrl", "无"), line("Why Matched", "whyMatched"), line("Goal Fit", "goalFit"),
        line("Evidence Strength", "evidenceStrength"), line("Source Quality / Recency", "sourceQualityRecency"),
        line("Key Uncertainty", "uncertainty"), line("Recommendation Outcome", "recommendationOutcome"),
        line("Confidence", "confidence"), optional("Decision", "decisionTag"),
        optional("Recommendation", "recommendation"), optional("Next Click", "nextStep"),
        optional("Top Evidence", "topEvidence")).alias("section"))


# --- snapshot packs ------------------------------------------------------------------------
def pending_queries(queries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Resume: queries whose output is already listed as written are skipped."""
    return queries.join(manifest.filter("status = 'pass'").select("query_id"), "query_id", "left_anti")


def write_snapshot_pack(results: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Write ranked results partitioned by query id and return the manifest rows to append."""
    fresh = pending_queries(results, manifest)
    fresh.write.mode("append").partitionBy("query_id").parquet(path)
    return fresh.groupBy("query_id").agg(F.count(F.lit(1)).alias("total")).withColumn("status", F.lit("pass"))
