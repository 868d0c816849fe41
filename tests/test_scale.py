"""Hot keys, wide groups and the exact scan."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from peopleweave.config import RetrievalConfig
from peopleweave.functions import json, similarity
from peopleweave.operators import aggregates, common, index, joins, postings, retrieve, scan, vocabulary
from peopleweave.operators import vectors as vector_blocks
from peopleweave.operators.automaton import Automaton


def hot(spark, n=3000):
    """A third of all rows share one key."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
                                 F.pmod(F.xxhash64("id"), F.lit(997)).alias("v"), "id")


def test_positions_number_a_hot_key_exactly(spark):
    got = common.positions(hot(spark), ["key"], ["v", "id"], "pos").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["key"], []).append((r["v"], r["id"], r["pos"]))
    assert len(got) == 3000
    for rows in groups.values():
        assert [p for _, _, p in sorted(rows)] == list(range(1, len(rows) + 1))


def test_global_positions(spark):
    got = common.positions(spark.range(1000), [], [F.desc("id")], "pos").collect()
    assert all(r["pos"] == 1000 - r["id"] for r in got)


def test_exact_median_of_a_hot_key(spark):
    got = {r["key"]: r["median"] for r in aggregates.exact_median(hot(spark), ["key"], "v").collect()}
    rows = {}
    for r in hot(spark).collect():
        rows.setdefault(r["key"], []).append(r["v"])
    assert got == {k: float(np.median(v)) for k, v in rows.items()}


def test_document_text_of_a_person_with_much_evidence_is_one_whole_row(spark):
    people = spark.createDataFrame([(1, "N", None, None, "P"), (2, "M", "h", None, None)], "person_id int, name string, headline string, summary string, location string")
    items = spark.range(20_000).select(F.lit(1).alias("person_id"), F.format_string("e%05d", "id").alias("evidence_id"), F.concat(F.lit("w"), F.col("id")).alias("title"),
                                   F.lit(None).cast("string").alias("description"))
    rows = index.document_texts(people, items).collect()
    words = [w for r in rows if r["person_id"] == 1 for w in r["doc_text"].split() if w.startswith("w")]
    assert words == [f"w{i}" for i in range(20_000)] and len(rows) == 2
    assert [r["doc_text"] for r in rows if r["person_id"] == 2] == ["M h"]
    whole = index.document_texts(people, items).filter("person_id = 1").collect()
    assert len(whole) == 1 and whole[0]["doc_text"].split()[:3] == ["N", "P", "w0"]


def vectors(spark, n=400, dim=16, q=7):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[10:20] = data[10]  # copies tie and the smaller id wins
    asked = data[[10] + list(range(30, 30 + q - 1))]
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(n, [1.0, 2.0]), (n + 1, [])], "person_id long, embedding array<float>")
    v = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(asked)] + [(99, [])], "query_id long, embedding array<float>")
    return data.astype(float), asked.astype(float), e, v


def bare(spark, ids, status="active"):
    none = F.array().cast("array<string>")
    q = ids.select("query_id", F.lit("x").alias("raw_query"), *[none.alias(c) for c in ("roles", "skills", "locations", "must_haves", "nice_to_haves")],
                   F.lit(None).cast("string").alias("source_bias"))
    return retrieve.prepare_queries(q)


def vector_docs(e):
    none = F.array().cast("array<string>")
    return e.select("person_id", F.lit("").alias("doc_text"), none.alias("facet_location"), none.alias("facet_source"), F.lit("").alias("location"), F.lit("active").alias("status"))


def nearest(asked, data, k):
    with np.errstate(invalid="ignore"):
        sims = np.nan_to_num(asked @ data.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(data, axis=1)[None, :])
    return {(q, i) for q in range(len(asked)) for i in sorted(range(len(data)), key=lambda i: (-round(sims[q, i], 9), i))[:k]}


@pytest.mark.parametrize("tile, block, first", [(1024, 2048, 8192), (3, 30, 40)])
def test_vector_search_is_exact_also_in_tiles_and_blocks(spark, monkeypatch, tile, block, first):
    monkeypatch.setattr(retrieve, "tiled", lambda df: scan.tiled(df, tile))
    monkeypatch.setattr(retrieve, "build_vectors", lambda df: vector_blocks.build_vectors(df, 8, block))
    near, further = vector_blocks.VectorIndex.nearest, vector_blocks.VectorIndex.further
    monkeypatch.setattr(vector_blocks.VectorIndex, "nearest", lambda self, q: near(self, q, first))
    monkeypatch.setattr(vector_blocks.VectorIndex, "further", lambda self, q, h, k: further(self, q, h, k, first))
    data, asked, e, v = vectors(spark)
    hits = retrieve.vector_hits(bare(spark, v), v, vector_docs(e), e, RetrievalConfig(limit=5)).collect()
    assert {(r["query_id"], r["person_id"]) for r in hits} == nearest(asked, data, 5)


def test_vector_blocks_out_of_reach_are_not_met(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(6)
    data = np.array([centres[i % 6] + rng.normal(size=6) * 0.01 for i in range(600)] + [np.zeros(6)])
    asked = np.vstack([centres[:2] * 3, np.zeros((1, 6))])
    odd = [(7000, [float("nan")] * 6), (7001, [float("inf")] * 6), (7002, [1.0, None] + [0.0] * 4), (7003, None)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + odd, "person_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, embedding array<double>").withColumn("dim", F.size("embedding"))
    built = vector_blocks.build_vectors(rows, 64, 20)
    first = built.nearest(q, 50)
    hits = spark.createDataFrame([(0, 0.99)] * 5 + [(1, 0.99)] * 5 + [(2, 0.0)] * 5, "query_id long, rank_score double")
    met = {i: n for i, n in first.unionByName(built.further(q, hits, 5, 50)).groupBy("query_id").count().collect()}
    blocks = built.rows.select("block").distinct().count()
    assert met[2] == blocks and met[0] < blocks / 2 and met[1] < blocks / 2
    again = first.intersect(built.further(q, hits, 5, 50))
    assert again.isEmpty()
    got = retrieve.vector_hits(bare(spark, q), q.drop("dim"), vector_docs(rows), rows, RetrievalConfig(limit=7)).collect()
    assert {(r["query_id"], r["person_id"]) for r in got} == nearest(asked, data, 7)


def people(spark, n=700):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(160)] + ["c++", "浙大", "naïve", "rag", "x_y", "multi-part", "go", "ai"]
    text = lambda k: " ".join(rng.choice(words, k))
    rows = [(i, text(int(rng.integers(0, 60))), [str(x) for x in rng.choice(["engineer", "Writer", "chef"], 1)] if i % 3 else None, ["hangzhou" if i % 4 else "oslo"], ["github"] if i % 5 else ["bonjour", "github"],
             [str(rng.choice(words))], " ".join(rng.choice(words, 2)) if i % 7 else str(rng.choice(words)), "Hangzhou", "active" if i % 11 else "hidden") for i in range(n)]
    docs = spark.createDataFrame(rows, "person_id long, doc_text string, facet_role array<string>, facet_location array<string>, facet_source array<string>, facet_tags array<string>, name string, location string, status string")
    asked = [(i, text(int(rng.integers(0, 5))), ["engineer"] if i % 4 == 0 else [], [str(rng.choice(words))] if i % 3 else ["c++", "go"], ["oslo"] if i % 6 == 0 else [], [str(rng.choice(words))] if i % 5 == 0 else [], [],
              "bonjour" if i % 7 == 0 else None) for i in range(40)]
    asked += [(90, "open source rag", [], ["rag"], [], [], [], None), (91, "", [], [], [], [], [], None), (92, str(rows[7][6]), [], [], [], [], [], None)]
    queries = spark.createDataFrame(asked, "query_id long, raw_query string, roles array<string>, skills array<string>, locations array<string>, must_haves array<string>, nice_to_haves array<string>, source_bias string")
    return docs, queries


def test_keyword_search_over_many_blocks_and_tiles_equals_one_block(spark, monkeypatch):
    docs, queries = people(spark)
    prepared = retrieve.prepare_queries(queries)
    cfg = RetrievalConfig(limit=20)
    columns = ["query_id", "person_id", "rank", "sim", "rank_score", *[f"m_{f}" for f in retrieve.FLAGS]]

    def run(every_block):
        if every_block:
            monkeypatch.setattr(retrieve, "meeting_blocks", lambda q, index, t: q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(index.count - 1))).alias("block")))
        return sorted(tuple(r) for r in retrieve.keyword_hits(prepared, index_, cfg).select(*columns).collect())

    index_ = postings.build_index(docs, block_rows=40)
    monkeypatch.setattr(retrieve, "tiled", lambda df: scan.tiled(df, 7))
    few = run(False)
    assert few and few == run(True)


def test_blocks_without_common_grams_or_terms_are_left_out(spark):
    docs, queries = people(spark)
    index_ = postings.build_index(docs, block_rows=40)
    blocks = index_.rows.select("block").distinct().count()
    assert blocks >= 15 and index_.rows.count() == docs.filter("status = 'active'").count()
    short = queries.filter("query_id = 92").unionByName(queries.filter("query_id = 92").withColumns({"query_id": F.lit(93).cast("long"), "raw_query": F.lit("kkkk qqqq"), "source_bias": F.lit("nowhere")}))
    short = short.unionByName(queries.filter("query_id = 92").withColumns({"query_id": F.lit(94).cast("long"), "raw_query": F.lit("kkkk")}))
    met = {r["query_id"]: r["count"] for r in postings.meeting_blocks(retrieve.prepare_queries(short), index_, 0.08).groupBy("query_id").count().collect()}
    assert met[92] >= 1 and 93 not in met and 94 not in met
    assert retrieve.keyword_hits(retrieve.prepare_queries(short), docs.limit(0)).isEmpty()


def test_gram_codes_agree_with_the_column_version(spark):
    texts = ["Ab cd", "", "naïve  浙大 x_y 12", "𝒳yz ok", None, "a-b_c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("norm", retrieve.normalize_index_text("t"))
    for r in df.select("norm", F.array_sort(F.transform(similarity.trigrams("norm"), postings.gram_key)).alias("codes")).collect():
        assert postings.text_grams(r["norm"]).tolist() == r["codes"]


def test_keyword_scan_filters_and_k_above_the_list(spark):
    docs = spark.createDataFrame([
        (1, "RAG and retrieval work", ["Engineer"], ["hangzhou"], ["github"], ["rag"], "Ann Lee", "Hangzhou", "active"),
        (2, "plain text", ["engineer"], ["beijing"], ["bonjour"], [], "Bob", None, "active"), (3, "RAG too", ["engineer"], ["hangzhou"], ["github"], ["rag"], "Eve", None, "hidden"),
        (4, "dragon tales", [], ["上海"], ["github"], [], "ann", "上海", "active")],
        "person_id long, doc_text string, facet_role array<string>, facet_location array<string>, facet_source array<string>, facet_tags array<string>, name string, location string, status string")

    def ask(**kw):
        row = {"query_id": 1, "raw_query": "zz", "roles": [], "skills": [], "locations": [], "must_haves": [], "nice_to_haves": [], "source_bias": None, **kw}
        q = spark.createDataFrame([tuple(row.values())], "query_id long, raw_query string, roles array<string>, skills array<string>, locations array<string>, must_haves array<string>, nice_to_haves array<string>, source_bias string")
        return {r["person_id"]: r for r in retrieve.keyword_hits(retrieve.prepare_queries(q), docs).collect()}

    assert set(ask(skills=["RAG"])) == {1}                       # whole word only, hidden row out
    assert set(ask(roles=["engineer"])) == {1, 2}                # role facet compared lower-case
    assert set(ask(roles=["engineer"], locations=["Hangzhou"])) == {1}
    assert set(ask(roles=["engineer"], source_bias="bonjour")) == {2}
    assert set(ask(roles=["engineer"], must_haves=["rag"])) == {1}
    assert set(ask(raw_query="ann")) >= {1, 4}
    got = ask(raw_query="ann")
    assert got[4]["m_exact_name"] and not got[1]["m_exact_name"] and got[1]["m_prefix_name"] and not got[4]["m_prefix_name"]
    assert ask(raw_query="qq") == {}
    open_source = ask(raw_query="open source rag", skills=["rag"])
    assert open_source[1]["m_code_source"] and open_source[1]["m_specialized"] and open_source[1]["keyword_score"] <= 1.0


def test_query_reuse_respects_time_and_capacity(spark):
    from peopleweave.config import QueryCacheConfig
    rows = [(i, f"2024-01-01 00:{i:02d}:00", [1.0, 0.01 * i]) for i in range(10)] + [(10, "2024-01-01 03:00:00", [1.0, 0.0])]
    log = spark.createDataFrame(rows, "log_id long, t string, embedding array<float>").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r["log_id"]: r["hit_id"] for r in joins.reusable_queries(log, QueryCacheConfig(max_entries=3)).collect()}
    assert got == {i: i - 1 for i in range(1, 10)}  # nearest earlier entry; nothing left after the hour


def test_hot_facet_values_are_counted_once(spark):
    df = spark.range(5000).select(F.lit("p").alias("person_id"), (F.col("id") % 4).cast("string").alias("tag"))
    assert common.distinct_values(df, ["person_id"], "tag", "tags").first()["tags"] == ["0", "1", "2", "3"]


def test_exact_median_of_a_key_with_a_million_values_in_no_single_task(spark):
    n = 1_000_001
    df = spark.range(n).select(F.lit("hot").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(10 ** 12)) / 7.0).alias("v")).unionByName(
        spark.range(1001).select(F.lit("small").alias("key"), F.col("id").cast("double").alias("v"))).unionByName(
        spark.range(6000).select(F.lit("odd").alias("key"), F.expr("CASE WHEN id < 10 THEN -double('inf') WHEN id > 5000 THEN double('nan') WHEN id % 2 = 0 THEN -1e300 * id ELSE id * 1e-300 END").alias("v")))
    got = {r["key"]: r["m"] for r in aggregates.exact_median(df, ["key"], "v", "m").collect()}
    hot_values = np.sort(np.array([r["v"] for r in df.filter("key = 'hot'").select("v").toLocalIterator()]))
    odd = sorted((r["v"] for r in df.filter("key = 'odd'").collect()), key=lambda v: (np.isnan(v), v))
    assert got == {"hot": float(hot_values[n // 2]), "small": 500.0, "odd": (odd[2999] + odd[3000]) / 2}


def test_refinement_equals_the_running_count(spark):
    df = hot(spark).withColumn("v", F.col("v") * 0.5 - 100)
    a = {r["key"]: r["median"] for r in aggregates.exact_median(df, ["key"], "v", few=0).collect()}
    assert a == {r["key"]: r["median"] for r in aggregates.exact_median(df, ["key"], "v").collect()}
    assert aggregates.exact_median(df.limit(0), ["key"], "v").count() == 0


def test_facts_of_a_hot_handle_stay_in_long_form(spark):
    rows = spark.range(300_000).select(F.lit("hot").alias("handle"), F.lit("post").alias("source_kind"), F.concat(F.lit("c"), F.col("id") % 5).alias("category"), F.lit(None).cast("string").alias("category_title"),
                                       F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(" ").alias("description"), F.lit(None).cast("string").alias("external_source"))
    counts, facts = aggregates.handle_facts(rows)
    assert counts.first()["occurrences"] == 300_000
    assert {r["kind"]: r["count"] for r in facts.groupBy("kind").count().collect()} == {"names": 300_000, "categories": 5, "category_titles": 5, "source_kinds": 1}
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "value#" in plan.split("hashpartitioning(")[1].split(")")[0]
    few = aggregates.accumulate_handles(rows.limit(3)).first()
    assert few["names"] == sorted(few["names"]) and few["descriptions"] == [] and few["category_titles"] == few["categories"]


def test_automaton_finds_what_plain_search_finds():
    rng = np.random.default_rng(6)
    for _ in range(200):
        draw = lambda most: "".join(rng.choice(list("abé"), int(rng.integers(1, most))))
        patterns = sorted({draw(6) for _ in range(12)})
        text = draw(60)
        assert Automaton(patterns).found(text) == {i for i, p in enumerate(patterns) if p in text}
    assert Automaton([]).found("abc") == set() and Automaton(["a"]).found("") == set()


def test_vocabulary_of_several_blocks(spark):
    rng = np.random.default_rng(7)
    words = sorted({"".join(rng.choice(list("abcde"), 5)) for _ in range(1500)})
    table = spark.createDataFrame([(f"c{i % 40}", w.upper() if i % 3 else w) for i, w in enumerate(words)] + [("any", "a"), ("none", ""), ("null", None), ("c1", words[0])], "canonical string, pattern string")
    texts = [(i, " ".join(rng.choice(words, 6)) + "a" * int(i % 2)) for i in range(60)] + [(100, None), (101, ""), (102, "A" * 500)]
    got = {(r["row_id"], r["canonical"]) for r in vocabulary.table_hits(spark.createDataFrame(texts, "row_id long, text string"), table, most=400).collect()}
    pairs = [(r["canonical"], r["pattern"].lower()) for r in table.collect() if r["pattern"]]
    assert got == {(i, c) for i, t in texts for c, p in pairs if p in (t or "").lower()}
    assert vocabulary.table_hits(spark.createDataFrame(texts, "row_id long, text string"), table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vocabulary.vocabulary_dict(table, most=10)


def test_large_vocabulary(spark):
    table = spark.range(1_000_000).select(F.concat(F.lit("c"), F.col("id") % 1000).alias("canonical"), F.concat(F.lit("k"), F.col("id"), F.lit(";")).alias("pattern"))
    texts = spark.createDataFrame([(1, "the k17; and k999999; end"), (2, "k1000000; the"), (3, "xk5;k5;")], "row_id long, text string")
    assert {(r["row_id"], r["canonical"]) for r in vocabulary.table_hits(texts, table).collect()} == {(1, "c17"), (1, "c999"), (3, "c5")}


def test_nested_strings_of_json(spark):
    import json as js
    values = [{"a": "x", "b": ["y ", {"c": " ", "d\"k:": "q\"uo\\te: \n", "e": [1, None, True, ["deep 中", "\U0001f600"]]}], "": "z:"}, "top", ["k: v", "k"], {}, 5]

    def walk(v):
        if isinstance(v, str):
            return [v.strip()] if v.strip() else []
        return [s for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) for s in walk(x)]
    rows = [(i, js.dumps(v, ensure_ascii=bool(i % 2)), walk(v)) for i, v in enumerate(values)] + [(10, None, []), (11, "{bad", []), (12, js.dumps({"long": "x\\y" * 20_000}), ["x\\y" * 20_000])]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, t string")
    assert {r["id"]: r["s"] for r in df.select("id", json.nested_strings("t").alias("s")).collect()} == {i: w for i, _, w in rows}


def test_grams_are_made_piece_by_piece_whatever_the_blocks():
    import pyarrow as pa
    texts = [f"word{i % 7} ä_{i % 3} x" for i in range(3_000)]
    made = list(postings._with_grams([pa.record_batch({"block": pa.array([i % 300 for i in range(3_000)], pa.int32()), "norm": pa.array(texts)})]))
    assert max(b.num_rows for b in made) <= postings.PIECE_ROWS and pa.Table.from_batches(made)["norm"].to_pylist() == texts
    whole = pa.Table.from_batches(made).select(["block", "grams"]).combine_chunks().to_batches()
    posted = list(postings._block_grams(whole))
    assert len(posted) <= 3  # not one per block
    got = {(x["block"], x["key"]) for b in posted for x in b.to_pylist()}
    assert got == {(i % 300, int(k)) for i, t in enumerate(texts) for k in postings.text_grams(t)}


def test_words_of_a_slice_of_texts():
    import pyarrow as pa
    texts = pa.array(["rag go", None, "", "浙大 c3po x_y", "naïve-ish"])
    words = lambda t: [[w for w in found if w] for found in scan.ascii_words(t).to_pylist()]
    assert words(texts) == [["rag", "go"], [], [], ["c3po", "x_y"], ["na", "ve", "ish"]]
    assert words(texts.slice(3)) == [["c3po", "x_y"], ["na", "ve", "ish"]] and words(texts.slice(0, 0)) == []


def test_pair_scoring_retrieves_once(spark, tables, monkeypatch):
    from peopleweave.catalog import QUERIES, search
    calls = []
    hits = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.5, 1)], "query_id long, person_id long, keyword_score double, vector_score double, combined_score double, rank int")
    monkeypatch.setattr(search, "hybrid", lambda t: calls.append(1) or hits)
    assert QUERIES["rnk4_pair_scoring"](tables).columns == ["query_id", "person_id", "rank", "final_score", "pair_score"] and len(calls) == 1
