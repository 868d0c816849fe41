"""Readers: landed files to DataFrames, and scans of stored tables.

File readers are split in two: a scan that gives (file, text) rows and a parse step that is a
plain DataFrame function, so the parsing runs in parallel over any number of files.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, col, trim_ws
from ..operators.common import best_row, top_k

CONTAINER_KEYS = ["valid", "handles", "profiles", "items", "results", "data"]
HANDLE_KEYS = ["handle", "profile_link", "profileLink", "sourceHandle", "slug", "username"]


# --- scans of stored tables ------------------------------------------------------------
def scan_by_source(profiles: DataFrame, source: str, limit: int = 100) -> DataFrame:
    return profiles.filter(F.col("source") == source).orderBy(F.desc("synced_at"), "profile_id").limit(limit)


def scan_by_handles(profiles: DataFrame, source: str, handles: DataFrame) -> DataFrame:
    """An empty handle table gives an empty result; the join side is broadcast by AQE only when small."""
    return profiles.filter(F.col("source") == source).join(handles.select("handle").distinct(), "handle", "left_semi")


def rows_by_id(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def evidence_page(evidence: DataFrame, ids: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each person's evidence, newest first, with the person's total count."""
    limit, offset = max(1, min(200, limit)), max(0, offset)
    wanted = rows_by_id(evidence, ids, "person_id")
    totals = wanted.groupBy("person_id").agg(F.count(F.lit(1)).alias("total"))
    page = top_k(wanted, ["person_id"], [F.desc("created_at"), "evidence_id"], limit + offset, "position")
    return page.filter(F.col("position") > offset).join(totals, "person_id")


# --- files -------------------------------------------------------------------------------
def scan_files(spark: SparkSession, path: str) -> DataFrame:
    # file_path is a URI: undo its escapes once to get the name on disk.
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (spark.read.option("wholetext", True).text(path)
            .select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"),
                    F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def parse_profile_files(files: DataFrame) -> DataFrame:
    """(file, text) -> (handle, raw_payload); the file name is the URL-encoded handle."""
    return files.filter(F.col("file").endswith(".json")).select(
        F.url_decode(F.regexp_replace("file", r"(?i)\.json$", "")).alias("handle"), F.col("text").alias("raw_payload"))


def read_profile_dump(spark: SparkSession, dump_dir: str, index_path: str | None = None) -> DataFrame:
    """With an index: its rows having both a handle and a path; without: every file in ``profiles/``."""
    if index_path is None:
        return parse_profile_files(scan_files(spark, f"{dump_dir}/profiles"))
    index = (spark.read.option("multiLine", True).schema("handle string, filePath string").json(index_path)
             .filter(blank_to_null("handle").isNotNull() & blank_to_null("filePath").isNotNull()))
    index = index.withColumn("file", F.element_at(F.split("filePath", "/"), -1))
    return index.join(scan_files(spark, f"{dump_dir}/profiles").select("file", "text"), "file").select("handle", F.col("text").alias("raw_payload"))


FRIEND_SCHEMA = ("friend array<struct<profile_link:string,name:string,avatar:string,description:string,create_time:string>>,"
                 "friended array<struct<profile_link:string,name:string,avatar:string,description:string,create_time:string>>")


def parse_friend_files(files: DataFrame) -> DataFrame:
    """(file, text) -> one row per listed neighbour with its edge type."""
    parsed = files.select("file", F.from_json("text", FRIEND_SCHEMA).alias("j"))
    sides = [parsed.select("file", F.posexplode(F.col(f"j.{side}")).alias("pos", "n")).withColumn("edge_type", F.lit(side))
             for side in ("friend", "friended")]
    both = sides[0].unionByName(sides[1])
    return both.select(
        "file", "edge_type", trim_ws(F.col("n.profile_link")).alias("dst"), blank_to_null(F.col("n.name")).alias("name"),
        blank_to_null(F.col("n.avatar")).alias("avatar"), blank_to_null(F.col("n.description")).alias("description"),
        blank_to_null(F.col("n.create_time")).alias("seen_at"),
        F.concat_ws("-", "file", "edge_type", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("seen_order")
    ).filter(F.col("dst") != "")


def read_friend_links(spark: SparkSession, dump_dir: str) -> DataFrame:
    return parse_friend_files(scan_files(spark, f"{dump_dir}/friend-links"))


def parse_handle_lists(files: DataFrame) -> DataFrame:
    """Handle lists in any of three shapes: JSON array, wrapped object, or text lines with # comments."""
    text = trim_ws("text")
    container = F.coalesce(*[F.when(F.get_json_object(text, f"$.{k}").startswith("["), F.get_json_object(text, f"$.{k}"))
                             for k in CONTAINER_KEYS])
    items = (F.when(text.startswith("["), F.from_json(text, "array<string>"))
             .when(text.startswith("{"), F.coalesce(F.from_json(container, "array<string>"), F.array(text)))
             .otherwise(F.filter(F.transform(F.split(text, r"\r?\n"), trim_ws), lambda l: ~l.startswith("#"))))
    rows = files.select("file", F.posexplode(items).alias("pos", "item"))
    item = trim_ws("item")
    is_object = item.startswith("{")

    def pick(keys):
        return F.coalesce(*[blank_to_null(F.get_json_object(item, f"$.{k}")) for k in keys])

    return rows.select("file", "pos", F.when(is_object, pick(HANDLE_KEYS)).otherwise(item).alias("handle"),
                       F.when(is_object, pick(["name", "displayName"])).alias("name"),
                       F.when(is_object, pick(["sourceProfileId"])).alias("source_profile_id")
                       ).filter(F.coalesce(F.col("handle"), F.lit("")) != "")


def read_handle_lists(spark: SparkSession, path: str) -> DataFrame:
    return parse_handle_lists(scan_files(spark, path))


EVAL_QUERY_SCHEMA = "id string, text string, category string, expectedRoles array<string>, expectedSkills array<string>"
GOLDEN_SCHEMA = "queryId string, personId string, relevance string, notes string"


def parse_records(lines: DataFrame, schema: str, required: list[str], allowed: dict | None = None):
    """JSON text rows -> (valid rows, rejected rows with the text)."""
    parsed = lines.select("text", F.from_json("text", schema).alias("j"))
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(f"j.{name}").isNotNull()
    for name, values in (allowed or {}).items():
        ok = ok & F.col(f"j.{name}").isin(values)
    flagged = parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("ok").select("j.*"), flagged.filter("NOT ok").select("text")


def read_golden_set(spark: SparkSession, path: str):
    """A JSON array file of judgements, split into valid and rejected rows."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "array<string>")).alias("text"))
    return parse_records(rows, GOLDEN_SCHEMA, ["queryId", "personId", "relevance"],
                         {"relevance": ["high", "medium", "low"]})


def read_eval_queries(spark: SparkSession, path: str):
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "array<string>")).alias("text"))
    return parse_records(rows, EVAL_QUERY_SCHEMA, ["id", "text", "category"])


# --- seed discovery over landed posts ------------------------------------------------------
def discover_seeds(refs: DataFrame, limit: int | None = None, expand: int = 3, posts_per_profile: int = 5) -> DataFrame:
    """Unique handles in order of category priority; the first references of a category also bring
    in the handles of their own newest posts.

    refs: (post_id, category, priority, post_order, ref_order, handle)
    """
    refs = refs.filter(F.coalesce(F.col("handle"), F.lit("")) != "")
    direct = refs.select("handle", F.lit("category").alias("via"), F.col("category").alias("origin"),
                         F.struct((-F.col("priority")).alias("p"), F.col("category").alias("c"), F.lit(0).alias("x"),
                                  F.col("post_order").alias("o"), F.col("ref_order").alias("r")).alias("rank"))
    first = top_k(refs, ["category"], ["post_order", "ref_order"], expand, "slot")
    origins = first.select("category", "priority", F.col("slot").cast("long").alias("slot"), F.col("handle").alias("origin"))
    own_posts = refs.select(F.col("handle").alias("origin"), "post_id", "post_order").distinct().join(
        origins.select("origin").distinct(), "origin", "left_semi")
    own_posts = top_k(own_posts, ["origin"], [F.desc("post_order"), "post_id"], posts_per_profile, "k").select(
        "origin", "post_id")
    neighbours = (origins.join(own_posts, "origin").join(refs.select("post_id", "handle", "ref_order"), "post_id")
                  .select("handle", F.lit("profile_link").alias("via"), "origin",
                          F.struct((-F.col("priority")).alias("p"), F.col("category").alias("c"), F.lit(1).alias("x"),
                                   F.col("slot").alias("o"), F.col("ref_order").alias("r")).alias("rank")))
    merged = best_row(direct.unionByName(neighbours), ["handle"], F.struct("rank", "via", "origin"), maximum=False)
    if limit is not None:
        merged = merged.orderBy("rank", "handle").limit(limit)
    return merged.drop("rank")
