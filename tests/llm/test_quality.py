import random
from collections import Counter

from pyspark.sql import functions as F

from peopleweave.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, kept string, low_word_length long"


def clean(rng, n=80):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 6))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, clean(rng), "en", f"s{i % 2}", "x", 1) for i in range(300)]
    rows += [(1000 + i, clean(rng).replace(" ", "### "), "en", "s0", "x", 1) for i in range(12)]             # junk in a clean source
    rows += [(2000 + i, clean(rng).replace(" ", " | "), "en", "table", "x", 1) for i in range(130)]           # a source where symbols are usual
    rows += [(3000 + i, clean(rng), "fr", "s0", "x", 1) for i in range(20)] + [(3100, clean(rng).replace(" ", "$$ "), "fr", "s0", "x", 1)]
    rows += [(4000, None, "en", "s0", "x", 1), (4001, "", None, None, "x", 1), (4002, clean(rng), None, None, "x", 1), (4003, clean(rng, 10), "en", "s0", "x", 1),
             (4004, ("eins zwei drei vier " * 40).strip(), "en", "s1", "x", 1), (4005, "\n".join([clean(rng, 20)] * 4 + [clean(rng, 900)]), "en", "s1", "x", 1),
             (4006, clean(rng, 30_000), "en", "s1", "x", 1), (None, clean(rng), "en", "s0", "x", 1)]
    return rows + [rows[0], rows[0]]


def brute(rows):
    def figures(text):
        n, chars, symbols, lines, dup, rep = Q.measure(text or "")
        return dict(word_length=1000 * chars // n if n else 0, symbol_rate=1000 * symbols // n if n else 0, dup_line_rate=1000 * dup // lines if lines else 0,
                    repeat_rate=1000 * rep // n if n else 0), n < 50 or 100 * rep > 50 * n
    def place(v):
        s = max(len(f"{v:b}") - 8, 0)
        return v >> s << s
    found = [(r, *figures(r[1])) for r in rows]
    good = [(r, f) for r, f, failed in found if not failed]
    out = []
    for r, f, failed in found:
        inside = True
        for pool in ([g for q, g in good if q[2:4] == r[2:4]], [g for q, g in good if q[2] == r[2]], [g for _, g in good]):
            if len(pool) >= 100 or len(pool) == len(good):
                break
        for name, width, low in Q.RULES:
            values = sorted(place(g[name]) for g in pool)
            q1, q3 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            wide = 3 * max(q3 - q1, width)
            inside &= f[name] <= q3 + wide and (not low or f[name] >= q1 - wide)
        out.append((r[0], failed, not failed and inside))
    return Counter(out)


def test_equals_brute_force_with_odd_rows(spark):
    rows = corpus()
    out = Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    got = Counter((r.doc_id, r.base_failed, r.kept) for r in out)
    assert got == brute(rows)
    kept = {r.doc_id for r in out if r.kept}
    assert not kept & set(range(1000, 1012)) and set(range(2000, 2130)) <= kept and set(range(300)) <= kept and 4006 in kept
    assert not kept & {4000, 4001, 4003, 4004} and {r.own for r in out if r.doc_id == 3000} == {"corpus"} and {r.own for r in out if r.doc_id == 2000} == {"source"}


def test_counts_of_one_text():
    assert Q.measure("") == (0, 0, 0, 0, 0, 0)
    assert Q.measure("a b") == (2, 2, 0, 1, 0, 0)
    assert Q.measure("a b c a b c") == (6, 6, 0, 1, 0, 6)
    assert Q.measure("a a a a") == (4, 4, 0, 1, 0, 4)
    assert Q.measure("x y z q x y z w\n#|\n#|\n \n \n") == (10, 12, 4, 3, 1, 6)
    assert Q.measure("é e\x0bü\x1fu") == (2, 6, 0, 1, 0, 0)


def test_repeat_words_against_plain_count():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        wins = Counter(zip(w, w[1:], w[2:]))
        marked = {i + k for i in range(len(w) - 2) for k in range(3) if wins[tuple(w[i:i + 3])] > 1}
        assert Q.measure(" ".join(w))[5] == len(marked)


def test_merged_sketches_equal_the_sketch_of_the_whole(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("abc"), rng.randint(0, 100_000)) for _ in range(3000)], "k string, v long")
    fine = Q.sketch(df, ["k"], ["v"])
    whole = {(r.place, r.n) for r in Q.sketch(df, [], ["v"]).collect()}
    assert whole == {(r.place, r.n) for r in Q.merge(fine, []).collect()}
    half = Q.quantiles(Q.merge(fine, []), [], {"half": (1, 2)}).first()["half"]
    exact = sorted(r.v for r in df.collect())[1499]
    assert half <= exact <= half * (1 + 2 ** -7)


def test_keep_good_returns_the_columns_of_the_input(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = Q.keep_good(df)
    assert out.columns == df.columns and {r.kept for r in out.collect()} == {"x"}
    assert Q.judge(df.limit(0)).count() == 0 and Q.keep_good(df.limit(0)).count() == 0
    assert Q.judge(df.filter(F.col("doc_id").isin(4000, 4003))).filter("kept").count() == 0
