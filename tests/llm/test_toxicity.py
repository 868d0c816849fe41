import random

from peopleweave.llm import toxicity as T


def corpus(n=240):
    random.seed(2)
    ordinary = ["the", "on", "tion", "ering", "shand", "thent", "whole", "ofred", "inand"]
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(ordinary) for _ in range(random.randint(5, 80))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[random.randrange(len(words))] = random.choice(["scumbag", "moron"]) + random.choice(["", "s", "ly"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


SCHEMA = "doc_id long, text string, score string"


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, marks, learn=T.learnable())
    got = {r.doc_id: r for r in T.score(docs, model, keep=["doc_id"]).collect()}
    held = {r.doc_id for r in docs.filter(~T.learnable()).collect()}
    wrong = [i for i, t in labels if i in held and got[i].predicted != t]
    assert len(held) > 50 and not wrong
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_labels_outside_the_fold_are_not_learnt(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    held = {r.doc_id for r in docs.filter(~T.learnable()).collect()}
    turned = [(i, 1 - t if i in held else t) for i, t in labels]
    scores = [{r.doc_id: r.score for r in T.score(docs, T.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"), learn=T.learnable()), keep=["doc_id"]).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_nulls_empties_repeats_and_clashing_columns(spark):
    rows, labels = corpus()
    odd = [(None, "moron the", "own"), (9001, None, None), (9002, "", "s"), (9003, "...", "s"), (9004, "the " * 50_000, "s"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (4, 0), (123456, 1)], "doc_id long, toxic int")
    out = T.drop_toxic(docs, marks)
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    assert {i for i, t in labels if not t} | {9001, 9002, 9003, 9004} == {r[0] for r in kept if r[0] is not None}
    assert (9001, None, None) in kept and (None, "moron the", "own") not in kept


def test_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame(corpus(5)[0], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score(docs, T.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in T.score(docs, T.train(docs, one)).collect()} == {1.0}
    assert T.score(docs.limit(0), T.train(docs.limit(0), one)).collect() == []


def test_model_is_a_distribution():
    counts = {g: (n, n % 3) for n, w in enumerate(["abc", "abd", "bcd", "aab"], 1) for g in T.grams(w)}
    model = T.KneserNey(counts)
    letters = {g[-1] for g in counts}
    for context in ("", "a", "ab"):
        # One share is left for characters that never occurred.
        assert abs(sum(model.shared(context + x) for x in letters) + model.shared(context + "?") - 1) < 1e-9
