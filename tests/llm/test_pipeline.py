import corpus_pipeline as C
from conftest import SF
from test_decontamination import brute
from test_simhash import brute_components, brute_fp

from peopleweave.llm import toxicity
from peopleweave.llm.queries import ORACLES, QUERIES


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels, learn=toxicity.learnable()), keep=["doc_id", "text"]).collect()
    clean = {r.doc_id: r.text for r in scored if r.score < 0.7}
    fps = {i: brute_fp(t) for i, t in clean.items()}
    group = brute_components(fps.values(), 3)
    first = {}
    for i in sorted(clean):
        first.setdefault(group[fps[i]], i)
    want = sorted(i for i in first.values() if not brute(clean[i], bench)[4])
    out = C.run(spark, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == want and len(want) < docs.count()
    encoded = {r.doc_id: r for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    assert all(got[i] == encoded[i] for i in want)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a text", "en", None, 6, "own"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "own"), (2, "", "en", "s", 0, "own")],
                                 "doc_id long, text string, lang string, source string, n_chars long, predicted string")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {"a text"} <= {r.text for r in out.collect()}
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert C.STAGES[-1][1](spark, docs, SF).count() == 4


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(C.STAGES) <= 5 and C.ORACLE_SQL is None
