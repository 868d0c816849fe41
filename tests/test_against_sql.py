"""Queries on small tables with values that once made them differ from their SQL."""
from peopleweave import catalog
from peopleweave.bindings import Tables
from peopleweave.operators import windows


class Few(Tables):
    """Given rows for some relations, the smallest tables for the rest."""

    def __init__(self, spark, **given):
        super().__init__(spark, "/root/testdata/sf0.001")
        self.given = given

    def raw(self, name):
        return self.given.get(name) or super().raw(name)

    def viewer_events(self):
        return self.given["viewer_events"]


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, viewer_id long, person_id long, kind string, tags array<string>, value double")


def test_a_score_above_one_is_no_percent_in_cards(spark):
    t = Few(spark, viewer_events=events(spark, [(1, 1, 1, "contacted", ["x"], 600.0), (2, 1, 2, "contacted", ["x"], 300.0), (3, 1, 3, "contacted", ["x"], 200.0)]),
            customer=spark.createDataFrame([(n, f"Customer#00000000{n}", 1, 100.0, "BUILDING") for n in (1, 2, 3)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    assert {r["person_id"]: r["strength"] for r in catalog.QUERIES["exp5_result_cards"](t).collect()} == {1: "strong", 2: "strong", 3: "medium"}


def test_invented_words_hold_no_title(spark):
    rows = [(1, 1, "Thorthea with this ofounder of onhable orha and more of it."), (1, 2, "ofounder"), (1, 3, None)]
    t = Few(spark, conversations=spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert {r["turn"]: r["noise"] for r in catalog.QUERIES["flt11_noise_segments"](t).collect()} == {1: True, 2: False, 3: None}


def test_gap_of_scores_on_both_sides_of_one(spark):
    rows = [(1, 1, 2, "contacted", ["x", "y"], 600.0), (2, 1, 2, "contacted", ["x"], 450.0), (3, 2, 2, "contacted", ["x", "y"], 4.0), (4, 2, 2, "contacted", ["x"], 1.0)]
    got = catalog.QUERIES["cmp5_export_confidence"](Few(spark, viewer_events=events(spark, rows))).collect()
    assert {r["person_id"]: r["confidence"] for r in got} == {1: "高信心", 3: "中信心"}


def test_composites_are_rounded_as_numbers(spark):
    # 0.5005 * 1000 is 500.49999999999994, so both composites are 0.5 and freshness decides.
    rows = [("q", 1, 0.5005, 0, 0, 0, 0.0), ("q", 2, 0.5004, 5, 0, 0, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, person_id long, composite double, fresh int, source int, evidence int, match double")
    assert [r["person_id"] for r in windows.rerank_order(df, "fresh").orderBy("rank").collect()] == [2, 1]


def test_aliases_are_worked_out_once(spark):
    plan = catalog.QUERIES["nrm5_alias_extraction"](Few(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_person_without_evidence_or_profile_has_no_sources(spark):
    customer = spark.createDataFrame([(7_000_001, "Customer#007000001", 1, 100.0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    got = catalog.QUERIES["idx1_document_build"](Few(spark, customer=customer)).collect()
    assert [(r["person_id"], r["facet_source"], r["evidence_count"]) for r in got] == [(7_000_001, None, 0)]


def documents(spark, rows):
    """(doc_id, text, n_chars) as documents."""
    return spark.createDataFrame([(k, text, "en", "src1", n) for k, text, n in rows], "doc_id long, text string, lang string, source string, n_chars long")


def vectors(spark, rows):
    """(vec_id, label) as embeddings."""
    return spark.createDataFrame([(k, [1.0], label) for k, label in rows], "vec_id long, embedding array<float>, label int")


def test_only_vectors_of_blank_texts_are_zero(spark):
    # The signs of the trigrams of "itu" cancel out. SQL's trim takes all kinds of spaces, no line ends, and null is no blank text.
    texts = ["", "   ", " \u00a0\u3000", "itu", "word", "\n", None]
    t = Few(spark, documents=documents(spark, [(k, text, 9) for k, text in enumerate(texts)]), embeddings=vectors(spark, [(99, 1)]))
    got = {r["person_id"]: (r["dimension"], r["norm"]) for r in catalog.QUERIES["idx7_embed_stale"](t).collect()}
    assert got == {k: (64, 0.0 if k < 3 else 1.0) for k in range(len(texts))}
    assert [r["unit_length"] for r in catalog.QUERIES["udf1_embedder"](t).collect()] == [True] * len(texts)


def test_document_embedded_at_an_unknown_time_is_not_stale(spark):
    t = Few(spark, documents=documents(spark, [(1, "a", 5000), (2, "b", 5000), (3, "c", 10), (4, "d", 10)]), embeddings=vectors(spark, [(1, None), (2, 0), (3, 0)]))
    assert {r["person_id"]: r["missing"] for r in catalog.QUERIES["jn4_stale_documents"](t).collect()} == {2: False, 4: True}
    assert sorted(r["person_id"] for r in catalog.QUERIES["idx7_embed_stale"](t).collect()) == [2, 4]
