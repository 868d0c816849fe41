"""Files, sinks, streams and the composed jobs."""
import json
import os
import shutil

from pyspark.sql import functions as F

from peopleweave.bindings import EVENT_NOW, NOW
from peopleweave.catalog.evidence_index import DIRECTIONS
from peopleweave.catalog.people import goal_texts
from peopleweave.operators import aggregates, common
from peopleweave.plans import daily, ingest, search
from peopleweave.sources import readers, sinks
from peopleweave.streaming import jobs


def test_profile_dump_with_and_without_index(spark, tmp_path):
    os.makedirs(tmp_path / "profiles")
    for name in ("a%2Fb.json", "c.json", "note.txt"):
        (tmp_path / "profiles" / name).write_text(json.dumps({"name": name}))
    assert {r["handle"] for r in readers.read_profile_dump(spark, str(tmp_path)).collect()} == {"a/b", "c"}
    (tmp_path / "index.json").write_text(json.dumps([{"handle": "c", "filePath": "profiles/c.json"}, {"handle": " ", "filePath": "x"}, {"handle": "d"}]))
    got = readers.read_profile_dump(spark, str(tmp_path), str(tmp_path / "index.json")).collect()
    assert [(r["handle"], json.loads(r["raw_payload"])["name"]) for r in got] == [("c", "c.json")]


def test_handle_lists_and_golden_set(spark, tmp_path):
    os.makedirs(tmp_path / "h")
    (tmp_path / "h" / "a.json").write_text('["x", {"username": "y", "displayName": "Y"}, 5, {}]')
    (tmp_path / "h" / "b.json").write_text('{"data": [{"handle": " z "}]}')
    (tmp_path / "h" / "c.json").write_text('{"slug": "one"}')
    (tmp_path / "h" / "d.txt").write_text("# c\n\nq\r\n r \n")
    got = {r["handle"] for r in readers.read_handle_lists(spark, str(tmp_path / "h")).collect()}
    assert got >= {"x", "y", "z", "one", "q", "r"}
    (tmp_path / "g.json").write_text(json.dumps([{"queryId": "q", "personId": "p", "relevance": "high"}, {"queryId": "q", "personId": "p", "relevance": "?"}, {"personId": "p"}]))
    ok, bad = readers.read_golden_set(spark, str(tmp_path / "g.json"))
    assert ok.count() == 1 and bad.count() == 2


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_part=" in d}


def test_merge_rewrites_only_the_partitions_of_its_batch(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("key"), F.lit("old").alias("v"), F.lit(0).cast("long").alias("at"))
    table = sinks.keyed_table(rows, str(tmp_path / "t"), ["key"], 32)
    before = files_of(tmp_path / "t")
    batch = spark.createDataFrame([(3, "new", 5), (9, "new", 5), (9, "newer", 6), (1000, "added", 1)], "key long, v string, at long")
    merge = lambda old, new: common.newest_wins(old, new, ["key"], "at")
    touched = table.merge(batch, merge)
    after = files_of(tmp_path / "t")
    assert 1 <= len(touched) <= 3 and table.read(touched).count() < 400
    kept = {f: m for f, m in before.items() if int(f.split("_part=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == m for f, m in kept.items())
    want = {i: "old" for i in range(400)} | {3: "new", 9: "newer", 1000: "added"}
    for _ in range(2):  # a batch that is merged again changes nothing
        assert {r["key"]: r["v"] for r in table.read().collect()} == want
        assert table.merge(batch, merge) == touched
    assert table.merge(batch.limit(0), merge) == [] and table.read().count() == 401


def test_merge_into_an_empty_table_and_absent_rows(spark, tmp_path):
    cols = "person_id long, alias_type string, alias_value string, seq long"
    table = sinks.keyed_table(spark.createDataFrame([], cols), str(tmp_path / "t"), ["person_id"], 8)
    assert table.read().count() == 0
    rows = spark.createDataFrame([(1, "a", "x", 2), (1, "a", "x", 1), (2, "a", "y", 1), (None, "a", "z", 1)], cols)
    sinks.merge_absent(table, rows, sinks.append_new_aliases)
    sinks.merge_absent(table, rows.withColumn("seq", F.lit(0).cast("long")), sinks.append_new_aliases)
    assert sorted((r["person_id"], r["seq"]) for r in table.read().filter("person_id IS NOT NULL").collect()) == [(1, 1), (2, 1)]


def test_absent_rows_are_added_beside_stored_files(spark, tmp_path):
    cols = "person_id long, alias_type string, alias_value string, seq long"
    table = sinks.keyed_table(spark.createDataFrame([(i, "a", "x", 0) for i in range(50)], cols), str(tmp_path / "t"), ["person_id"], 4)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    sinks.merge_absent(table, spark.createDataFrame([(i, "a", v, s) for i in range(60) for v, s in (("x", 1), ("y", 2), ("y", 1))], cols), sinks.append_new_aliases)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    want = {(i, "x", 0 if i < 50 else 1) for i in range(60)} | {(i, "y", 1) for i in range(60)}
    got = table.read().collect()
    assert len(got) == len(want) and {(r["person_id"], r["alias_value"], r["seq"]) for r in got} == want


def test_csv_export_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', "x,y"), ("plain", None)], "c1 string, c2 string")
    assert {r["line"] for r in sinks.csv_lines(df).collect()} == {'"a ""b""","x,y"', "plain,"}
    sinks.write_csv_export(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {tuple(r) for r in back.collect()} == {('a "b"', "x,y"), ("plain", None)}


def test_upsert_matches_id_before_handle(spark):
    cols = "profile_id string, source string, source_profile_id string, handle string, display_name string, is_deleted boolean, synced_at timestamp, seen_at timestamp"
    old = spark.createDataFrame([("p1", "s", "1", "old", "A", False, None, None), ("p2", "s", None, "h2", "B", False, None, None)], cols)
    new = spark.createDataFrame([("s", "1", "new", "A2", 0), ("s", None, "h2", "B2", 1), ("s", "9", "h9", "C", 2), ("s", "9", "h9b", "C2", 3), ("s", None, "gone", "D", 4)],
                                "source string, source_profile_id string, handle string, display_name string, seq long")
    outs = spark.createDataFrame([("s", "gone", "processed")], "source string, handle string, status string")
    got = {r["handle"]: r for r in sinks.upsert_profiles(old, new, outs, NOW).collect()}
    assert set(got) == {"new", "h2", "h9b", "gone"} and got["new"]["profile_id"] == "p1" and got["h2"]["profile_id"] == "p2"
    assert got["gone"]["is_deleted"] and not got["h9b"]["is_deleted"]


def test_landed_profiles_are_worked_out_once(spark, tmp_path):
    cols = "profile_id string, source string, source_profile_id string, handle string, is_deleted boolean, synced_at timestamp, seen_at timestamp"
    table = sinks.keyed_table(spark.createDataFrame([], cols), str(tmp_path / "t"), ["profile_id"], 4)
    outs = spark.createDataFrame([("s", "h3", "processed")], "source string, handle string, status string")
    done = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(i):
        done.add(1)
        return f"h{i}"

    rows = spark.range(200).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_profile_id"), named("id").alias("handle"), F.col("id").alias("seq"))
    sinks.merge_profiles(table, rows, outs, NOW)
    assert done.value == 200
    assert {(r["source_profile_id"], r["handle"], r["is_deleted"]) for r in table.read().collect()} == {(str(i), f"h{i}", i == 3) for i in range(200)}


def test_payloads_of_one_row_group_are_made_in_many_tasks(spark, tables):
    for raw, rows in ((tables.raw_profiles(), tables.raw("customer")), (tables.raw_code_profiles(), tables.raw("supplier"))):
        assert rows.rdd.getNumPartitions() == 1
        made = raw.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(made) > min(4, spark.sparkContext.defaultParallelism) // 2 and sum(r["count"] for r in made) == rows.count()


def event_files(spark, tables, folder, parts=4):
    """Events in several files, delivered out of order."""
    rows = tables.all_viewer_events().select("event_id", "viewer_id", "person_id", "kind", "tags", "ts")
    for i in range(parts):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == i).coalesce(1).write.parquet(f"{folder}/p{i}")
        for name in os.listdir(f"{folder}/p{i}"):
            if name.endswith(".parquet"):
                shutil.move(f"{folder}/p{i}/{name}", f"{folder}/e{i}.parquet")
        shutil.rmtree(f"{folder}/p{i}")
    return rows


def test_stream_state_equals_batch_for_out_of_order_files(spark, tables, tmp_path):
    rows = event_files(spark, tables, str(tmp_path))
    schema = spark.read.parquet(str(tmp_path)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = jobs.run_available(jobs.viewer_state(stream), "update", ["viewer_id", "person_id"])
    want = aggregates.candidate_state(rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_upsert_replay_is_harmless(spark, tables, tmp_path):
    rows = event_files(spark, tables, str(tmp_path / "in"))
    table = sinks.keyed_table(rows.limit(0), str(tmp_path / "table"), ["viewer_id"], 4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge = lambda old, new: common.newest_wins(old, new, ["viewer_id"], F.struct("ts", "event_id", "kind"))
    for folder in ("c1", "c2"):  # the second run starts from nothing, as after a lost checkpoint
        jobs.upsert_stream(stream, table, merge, str(tmp_path / folder)).awaitTermination()
    got = {r["viewer_id"]: (r["ts"], r["event_id"], r["kind"]) for r in table.read().collect()}
    want = {}
    for r in rows.collect():
        key = (r["ts"], r["event_id"], r["kind"])
        want[r["viewer_id"]] = max(want.get(r["viewer_id"], key), key)
    assert got == want


def test_late_rows_go_to_the_side(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05"), (3, None)], "id int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    kept, late = jobs.split_late(df, "2024-01-03")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3] and [r["id"] for r in late.collect()] == [1]
    kept, late = jobs.split_late(df, None)
    assert kept.count() == 3 and late.count() == 0


def test_late_rows_of_a_stream_and_its_replay(spark, tmp_path):
    schema = "id long, ts timestamp"
    days = [[1, 2], [9, 1, 8], [], [7, 4, 12, None], [11, 10, 5]]
    for n, batch in enumerate(days):
        rows = [(100 * n + i, None if d is None else f"2024-01-{d:02d}") for i, d in enumerate(batch)]
        spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root, seen, upto, want = str(tmp_path / "out"), [], 0, set()
    for n, batch in enumerate(days):
        want |= {100 * n + i for i, d in enumerate(batch) if d is not None and d < upto - 2}
        upto = max([upto, *[d for d in batch if d]])
    for replay in range(2):  # the second run starts from nothing, as after a lost checkpoint, and overwrites what the first has written
        jobs.keep_late(stream, root, delay="2 days").awaitTermination()
        kept, late = jobs.late_tables(spark, root, stream.schema)
        assert sorted(r["id"] for r in late.collect()) == sorted(want) and kept.count() + late.count() == sum(map(len, days))
        os.rename(f"{root}/state", str(tmp_path / f"state{replay}"))


def test_windows_that_input_leaves_open_come_out_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", "seen") for d in (1, 1, 2, 5)], "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = sorted((r["day"], r["n"]) for r in jobs.run_to_end(stream, jobs.daily_counts, {"ts": "2999-01-01 00:00:00"}).collect())
    assert got == [("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-05", 1)]
    assert len(jobs.run_available(jobs.daily_counts(stream)).collect()) == 2


def test_search_job(spark, tables):
    docs = tables.search_docs()
    people = docs.select("person_id", "name", "headline", F.col("status"))
    q = tables.raw("benchmark").limit(5).select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    out = search.run_search(q, people, docs, tables.embeddings(), tables.evidence(), tables.query_vectors(), pair_scorer=True)
    cards = out["cards"].collect()
    assert cards and all(c["status"] == "active" for c in cards)
    assert out["result_warnings"].count() == 5 and out["retrieval_warnings"].count() == 5


def test_daily_job_suppresses_contacted(spark, tables):
    docs = tables.search_docs().select("person_id", F.col("updated_at").alias("doc_updated_at"), "facet_tags", "facet_source", "freshness")
    events = tables.all_viewer_events()
    out = daily.run_daily(tables.persons(), docs, tables.evidence(), events, goal_texts(tables), EVENT_NOW, directions=DIRECTIONS)
    listed = out["list"].select("viewer_id", "person_id", "rank").collect()
    contacted = {(r["viewer_id"], r["person_id"]) for r in events.filter("kind = 'contacted'").collect()}
    assert listed and max(r["rank"] for r in listed) <= 7 and not {(r["viewer_id"], r["person_id"]) for r in listed} & contacted
    assert out["surfaced"].count() == len(listed)


def test_ingest_job_hides_opted_out_people(spark, tables):
    empty = ("profile_id string, source string, source_profile_id string, handle string, url string, display_name string, headline string, bio string, summary string, avatar string, "
             "location string, aliases array<struct<type:string,value:string,confidence:double>>, profile_hash string, raw_payload string, is_deleted boolean, synced_at timestamp, seen_at timestamp")
    stored = spark.createDataFrame([], empty)
    for source, raw in (("bonjour", tables.raw_profiles()), ("github", tables.raw_code_profiles())):
        stored = ingest.store_profiles(stored, raw, source, tables.opt_outs(), NOW)
    from peopleweave.session import cut_lineage
    stored = cut_lineage(stored)
    gone = tables.opt_outs().filter("status = 'processed'")
    hidden = stored.join(gone, ["source", "handle"], "left_semi")
    assert hidden.count() > 0 and hidden.filter("NOT is_deleted").isEmpty()
    none = spark.createDataFrame([], "profile_id string, person_id string")
    out = ingest.resolve_people(stored, none, tables.opt_outs())
    links = cut_lineage(out["links"])
    assert links.join(hidden, "profile_id", "left_semi").isEmpty()
    assert links.count() == links.select("profile_id").distinct().count() == stored.filter("NOT is_deleted").count()
    people = links.select("person_id").distinct().withColumn("status", F.lit("active"))
    old = spark.createDataFrame([], "person_id string, source string, evidence_hash string, evidence_id string, created_at timestamp")
    items, errors = ingest.collect_evidence(people, links, stored, old, tables.opt_outs(), NOW)
    assert items.count() > 0 and errors.isEmpty()


def test_expiring_cache_over_batches_and_buckets(spark, tmp_path):
    hour = 3600
    batches = [[("a", "p", 0), ("a", "q", 0), ("b", "p", 0)] + [(f"k{n}", None, n) for n in range(200)], [("a", "r", 10 * hour), ("b", "z", -5)], [("c", "p", 30 * hour)], [("d", "s", 31 * hour)]]
    base = 1704067200
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "cache_key string, payload string, s long").coalesce(1)
        df.select("cache_key", "payload", F.timestamp_seconds(F.col("s") + base).alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    want = {("a", "q", 24, "stored"), ("b", "p", 24, "stored"), ("a", "r", 34, "stored"), ("c", "p", 54, "stored"), ("b", "p", 24, "expired"), ("d", "s", 55, "stored")}
    for buckets in (1, 7):
        out = jobs.run_available(jobs.expiring_cache(jobs.table_stream(spark, str(tmp_path / "in"), schema, 1), 24 * hour, buckets=buckets))
        rows = out.select("cache_key", "payload", F.expr(f"unix_micros(expires_at) / 1000000 - {base}").alias("s"), "event").collect()
        assert {(r[0], r[1], r[2] / hour, r[3]) for r in rows if r[0] in "abcd"} == want
        others = [(r[0], r[2] - 24 * hour, r[3]) for r in rows if r[0].startswith("k")]
        assert sorted(others) == sorted((f"k{n}", float(n), event) for n in range(200) for event in ("stored", "expired"))
