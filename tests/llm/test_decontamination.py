import hashlib
import random

from hypothesis import given, settings, strategies as st

from peopleweave.llm import decontamination as D

DOCS = "doc_id long, text string, n_hit string"


def brute(text, items, window=10):
    words = D.words_of((text or "").encode())
    hit, ids = set(), set()
    for item, t in items:
        w = D.words_of((t or "").encode())
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j:j + m] == w[i:i + m]:
                    hit.update(range(j, j + m))
                    if item is not None:
                        ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def compare(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=repr)
    assert rows_of(D.find_contamination(frame, bench, **options)) == want
    return want


def cases():
    random.seed(4)
    word = lambda: random.choice(["a", "b", "c", "The", "é", "x1"])
    text = lambda n: " ".join(word() + random.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(random.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(15)] + [(3, "a b"), (None, "c c c"), (77, None), (78, ""), (79, "!!"), (10, "a b"), (2, "a b")]
    docs = [(i, text(random.choice([0, 1, 5, 12, 200]))) for i in range(30)] + [(None, "a b c"), (1, None), (1, ""), (5, items[0][1]), (5, items[0][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    assert any(r[5] for r in compare(spark, docs, items))


def test_many_blocks_give_the_same(spark, monkeypatch):
    docs, items = cases()
    compare(spark, docs, items, block_bytes=100)
    monkeypatch.setattr(D, "CHUNK_WORDS", 4)
    compare(spark, docs, items, block_bytes=100)


def test_empty_tables(spark):
    assert compare(spark, [], [(1, "a b")]) == []
    assert compare(spark, [(1, "a b")], []) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "own"), (2, "q r s", "own"), (None, None, None)], DOCS)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = D.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == [(2, "q r s", "own"), (None, None, None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.sets(st.text("abc", min_size=4, max_size=4), min_size=1, max_size=8))
def test_matcher_finds_every_occurrence(text, patterns):
    text, patterns = [c.encode() for c in text], {tuple(c.encode() for c in p): p for p in patterns}
    want = [(i, patterns[tuple(text[i:i + 4])]) for i in range(len(text) - 3) if tuple(text[i:i + 4]) in patterns]
    assert list(D.WuManber(patterns).find(text)) == want


def test_a_block_is_loaded_once_per_task_and_alone(spark):
    docs, items = cases()
    items = [*items, *[(200 + i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(8)]]
    docs = [*docs, (900, "a " + " ".join(f"w3x{j}" for j in range(12)) + " b " + " ".join(f"w7x{j}" for j in range(1, 12)))]
    count, block_of = D.benchmark_blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", D.WINDOW, 400)
    blocks = [block_of(b) for b in range(count)]
    assert count > 2 and all(sum(len(t) for _, t in b) < sum(len(t) for b in blocks for _, t in b) for b in blocks)
    assert len({x for b in blocks for x in b}) == sum(map(len, blocks))
    assert any(r[0] == 900 and r[2] >= 23 for r in compare(spark, docs, items, block_bytes=400))


def test_runs_of_hits():
    assert D._runs(bytearray([0, 1, 1, 0, 1])) == [1, 3, 4, 5] and D._runs(bytearray()) == [] and D._runs(bytearray([1])) == [0, 1]
    assert D._covered([1, 3, 2, 5, 9, 10, 2, 3]) == 5
