import random

import numpy as np
import pytest
import xxhash

from peopleweave.llm import simhash as S
from peopleweave.llm.components import roots

SCHEMA = "doc_id long, text string, fp string"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, bits):
    values, group = sorted(set(values)), {}
    for v in values:
        near = {group[w] for w in group if (v ^ w).bit_count() <= bits}
        new = min(near | {v})
        for w in list(group):
            if group[w] in near:
                group[w] = new
        group[v] = new
    return group


def texts(n=150):
    random.seed(6)
    base = [" ".join(random.choice("abcdefgh") * random.randint(1, 4) for _ in range(120)) for _ in range(n // 5)]
    out = []
    for i in range(n):
        words = random.choice(base).split(" ")
        for _ in range(i % 4):
            words[random.randrange(len(words))] = "zz"
        out.append(" ".join(words))
    return out + ["", None, "A", "a b", "A\x0bB\x0cc  d", "é ß"]


def test_equals_brute_force(spark):
    rows = [(i * 3 % 100, t, "x") for i, t in enumerate(texts())] + [(None, "a b", "x"), (None, "only null here", "x"), (500, None, "x")]
    out = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", S.hex_fingerprint().alias("f"), "component_id").collect()
    fps = {t: brute_fp(t) for _, t, _ in rows}
    group, low = brute_components(fps.values(), 3), {}
    for i, t, _ in rows:
        g = group[fps[t]]
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    want = sorted(((i, t, f"{fps[t]:016x}", low[group[fps[t]]]) for i, t, _ in rows), key=repr)
    assert sorted(map(tuple, out), key=repr) == want
    assert len(set(low.values())) < len(rows) - 20


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
@pytest.mark.parametrize("bits", [1, 3, 4])
def test_links_and_components_for_any_plan(spark, bits, bucket_rows):
    rng = np.random.default_rng(bits)
    centres = rng.integers(-2**63, 2**63 - 1, 40)
    values = {int(c) for c in centres} | {int(c) ^ int(np.int64(1) << np.int64(int(a))) ^ int(np.int64(1) << np.int64(int(b))) for c in centres[:10] for a, b in rng.integers(0, 62, (40, 2))} | {0, 1, -1}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.child: r.parent for r in roots(S.link_edges(frame, bits, bucket_rows)).collect()}
    unsigned = brute_components([v % 2**64 for v in values], bits)
    mine, theirs = {}, {}
    for v in values:
        mine.setdefault(found.get(v, v), set()).add(v)
        theirs.setdefault(unsigned[v % 2**64], set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_unequal_thresholds_still_find_every_link(spark, monkeypatch):
    groups = [list(range(0, 20)), list(range(20, 44)), list(range(44, 64))]
    values = [(0,), (0b111,), (0b111 << 25,), ((1 << 5) | (1 << 30) | (1 << 50),), (1 << 62,)]
    for layout in ([(groups[0], 1), (groups[1], 0), (groups[2], 0)], [(groups[0], 2), (groups[2], 0)], [(groups[1], 0), (groups[0], -1), (groups[2], 2)]):
        monkeypatch.setattr(S, "plan", lambda v, b, layout=layout: [x for x in layout if x[1] >= 0])
        found = {r.child for r in roots(S.link_edges(spark.createDataFrame(values, "fp long"), 3)).collect()}
        assert found == {v for v, in values[1:]}, layout


def test_dynamic_programming_meets_the_pigeonhole_sum():
    costs = [{-1: 0, 0: 5, 1: 9, 2: 30, 3: 99}, {-1: 0, 0: 1, 1: 20, 2: 90, 3: 99}, {-1: 0, 0: 2, 1: 3, 2: 4, 3: 99}]
    cost, chosen = S.allocate(costs, 1)
    assert sum(chosen) == 1 and cost == 5 == sum(c[t] for c, t in zip(costs, chosen))


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "a b c d", "z"), (None, "alone with null", "z"), (None, "another with null", "z"), (7, "", "x"), (8, None, "x")]
    out = S.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "a b c d", "y"), (None, "alone with null", "z"), (None, "another with null", "z"), (7, "", "x")], key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert S.drop_near_duplicates(empty).collect() == [] and S.near_duplicates(empty).collect() == []


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)], "parent long, child long")
    found = {r.child: r.parent for r in roots(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 401)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_very_long_text():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert S.fingerprint(text.encode()) % 2**64 == brute_fp(text)
