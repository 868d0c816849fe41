import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from peopleweave.llm import suffix_tree as P
from peopleweave.llm.common import fold

SCHEMA = "doc_id long, text string, score string"


def corpus():
    random.seed(5)
    out = []
    for i in range(120):
        words = [random.choice(["a", "b", "C", "d", f"r{random.randint(0, 300)}"]) for _ in range(random.randint(0, 60))]
        if i % 2:
            words += "this line stands in many documents".split()
        out.append((i, " ".join(words), "x"))
    return out + [(None, "a b", None), (500, None, "x"), (501, "", "x"), (502, "a\x0bB \x1c ", "x"), (7, out[7][1], "x"), (503, "a " * 30_000, "x")]


def test_base_score_and_counts_equal_brute_force(spark):
    rows = corpus()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter()
    for i, t, _ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    out = P.score(spark.createDataFrame(rows, SCHEMA), fold("doc_id", 7) != 2, word_share=0.01, gram_share=0.002)
    assert "score" in out.columns and len(out.columns) == len(set(out.columns))
    got = sorted(((r.doc_id, r.text, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()), key=repr)
    want = sorted(((i, t, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6)) for i, t, _ in rows), key=repr)
    assert got == want


def test_tree_beats_single_words_on_held_out_rows(spark):
    out = P.score(spark.createDataFrame(corpus()[:120], SCHEMA), fold("doc_id", 7) != 2, word_share=0.003, gram_share=0.003).filter(fold("doc_id", 7) == 2)
    base, full, n = out.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert full > base + 0.1 * n


def levels_of(docs, width, depth, least):
    levels, seqs = [], {(w,): (w, None) for w in range(width)}
    for k in range(1, depth + 1):
        grams = Counter(tuple(d[i:i + k + 1]) for d in docs for i in range(len(d) - k))
        kept = {g: n for g, n in grams.items() if n >= least and g[:-1] in seqs and g[1:] in seqs}
        rows = sorted((seqs[g[:-1]][0] * width + g[-1], n, g) for g, n in kept.items())
        levels.append((np.array([c for c, _, _ in rows], np.int64), np.array([n for _, n, _ in rows], float)))
        seqs = {g: (i, n) for i, (_, n, g) in enumerate(rows)}
    return levels


def test_every_state_is_a_distribution_and_sequences_are_counted(spark):
    random.seed(3)
    width = 5
    docs = [[0, 1, 2, 3] * 6 + [random.randrange(width) for _ in range(20)] for _ in range(30)]
    levels = levels_of(docs, width, 3, 4)
    encoded = spark.createDataFrame([(bytearray(np.array(d, np.int32).tobytes()), True) for d in docs] + [(bytearray(np.array([4] * 50, np.int32).tobytes()), False)], "ids binary, learn boolean")
    for k, (codes, n) in enumerate(levels):
        got = P.sequence_counts(encoded, [c for c, _ in levels[:k]], width, 4)
        assert got[0].tolist() == codes.tolist() and got[1].tolist() == n.tolist()
    counts = np.bincount([w for d in docs for w in d], minlength=width).astype(float)
    single = (counts + 1) / (counts.sum() + width + 1)
    tree = P.SuffixTree(single, counts, levels)
    assert any(r.any() for r in tree.retained) and any(not r.all() for r in tree.retained)
    for context in ([0], [1, 2], [0, 1, 2], [4, 4, 1], [3, 0, 1, 2]):
        ps = [10 ** tree.logs(np.array([*context, w]))[0][-1] for w in range(width)]
        unknown = 10 ** tree.logs(np.array([*context, -1]))[0][-1] / (counts.sum() + width + 1)   # what reaches the single words, once for all unknown ones
        assert abs(sum(ps) + unknown - 1) < 1e-9, context


def test_no_rows_and_nothing_to_learn(spark):
    docs = spark.createDataFrame(corpus()[:3], SCHEMA)
    assert P.score(docs.limit(0), F.lit(True)).collect() == []
    rows = P.score(docs, F.lit(False)).collect()
    assert [r.n_known for r in rows] == [0, 0, 0] and all(r.score == r.base_score == 0 for r in rows)


def in_memory(docs, learn, depth, least):
    """Scores of the documents (lists of words) by the tree in memory."""
    words = sorted({w for d in docs for w in d})
    find = {w: i for i, w in enumerate(words)}
    ids = [[find[w] for w in d] for d in docs]
    trained = [d for d, on in zip(ids, learn) if on]
    counts = np.bincount([w for d in trained for w in d], minlength=len(words)).astype(float)
    tree = P.SuffixTree((counts + 1) / (counts.sum() + (counts > 0).sum() + 1), counts, levels_of(trained, len(words), depth, least))
    return [tree.logs(np.array(d))[0].sum() for d in ids]


def test_scores_equal_the_tree_in_memory_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 150)
    rows = corpus()[:130]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text, round(r.full, 6)) for r in P.score(docs.drop("score"), fold("doc_id", 7) != 2).withColumnRenamed("score", "full").collect()), key=repr)
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _, _ in rows]
    want = in_memory([P.tokens_of((t or "").encode()) for _, t, _ in rows], learn, P.DEPTH, 2)
    assert got == sorted(((i, t, round(s, 6)) for (i, t, _), s in zip(rows, want)), key=repr)


def test_a_passage_gives_context_however_large_the_corpus_is(spark):
    random.seed(8)
    passage = "seven green lamps hung over quiet water".split()
    noise = [(i, " ".join(f"n{random.randint(0, 50)}" for _ in range(3_000)), "x") for i in range(200)]
    told = [(1_000 + i, " ".join([f"u{i}", *passage]), "x") for i in range(4)]         # below 1e-5 of 600 000 tokens
    out = P.score(spark.createDataFrame(noise + told + [(5_000, " ".join(passage), "x")], SCHEMA), F.col("doc_id") < 5_000).filter("doc_id = 5000").first()
    assert out.score > out.base_score + 6 * 3
