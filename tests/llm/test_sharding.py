import random
import zlib
from collections import Counter, defaultdict

from peopleweave.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string"


def check(spark, rows, shards=8, units=S.UNITS):
    out = S.assign_shards(spark.createDataFrame(rows, SCHEMA), shards, units=units).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
    slots, by_text, load = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        by_text[r.text or ""].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in by_text.values())
    return load


def test_groups_slots_and_balance(spark):
    random.seed(1)
    rows = [(i, "é" * random.randint(0, 400), "x") for i in range(3000)] + [(None, None, None), (None, "", ""), (5, "é", "x"), (5, "é", "x")]
    load = check(spark, rows)
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 1 for _, t, _ in rows) * 12 and set(load) == set(range(8))


def test_bundles_and_a_hot_group(spark):
    rows = [(i, f"t{i} " + "w" * (i % 50), "x") for i in range(2000)] + [(9000 + i, "same text", "x") for i in range(1000)]
    load = check(spark, rows, shards=3, units=256)
    assert max(load.values()) < 1.05 * min(load.values())


def test_empty_and_single(spark):
    assert check(spark, []) == {}
    assert sum(check(spark, [(1, "a", None)]).values()) == 2


def test_schedule_is_longest_first():
    sizes = [("a", 7), ("b", 7), ("c", 6), ("d", 6), ("e", 5), ("f", 5), ("g", 4), ("h", 4), ("i", 4)]
    load = Counter()
    for unit, shard in S.schedule(sizes, 4).items():
        load[shard] += dict(sizes)[unit]
    assert sorted(load.values()) == [11, 11, 11, 15]


def test_written_shards(spark, tmp_path):
    S.write_shards(spark.createDataFrame([(i, f"text {i}", "x") for i in range(40)], SCHEMA), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
