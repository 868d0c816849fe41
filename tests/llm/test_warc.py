import base64
import hashlib
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from peopleweave.llm import warc as W
from peopleweave.llm.common import shared_folder
from peopleweave.llm.sharing import writing

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(spark, n=120):
    random.seed(7)
    rows = [(random.choice([None, *range(n)]), random.choice([None, "", "http://a.b/c", "https://www.x.org:443/?Q=1#f", "http://[bad", "http://é.fr/ü ü"]), random.choice([None, "", "same", "é" * 9, f"<p>{i}</p>", "x" * 200_000]), "x") for i in range(n)]
    return rows + rows[:2], spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(5)


def test_round_trip_and_global_order(spark):
    rows, frame = pages(spark)
    folder = shared_folder(spark, "test")
    archives = W.write_archives(frame, folder)
    index = W.merge_runs(W.sorted_runs(archives, folder), folder, fan_in=2, range_rows=20).collect()
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", []).append(i)
    low = {h: min((i for i in ids if i is not None), default=None) for h, ids in first.items()}
    want = []
    for i, _, h, _ in rows:
        raw, lowest = (h or "").encode(), low[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), digest, *(("response", None) if i == lowest else ("revisit", lowest))))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=repr) == sorted(want, key=repr)
    ordered = [(r.url_key, r.date, r.page_id is None, r.page_id or 0) for r in sorted(index, key=lambda r: (r.range, r.position))]
    assert ordered == sorted(ordered) and len({r.range for r in index}) > 2
    r = next(r for r in index if r.record_type == "response" and r.payload_bytes > 9)
    assert W.payload_digest(W.read_payload(r.archive, r.offset, r.length)) == r.payload_digest


def test_rolled_archives(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 500)
    rows = [(i, f"http://h/{i % 7}", f"page {i}", "x") for i in range(40)]
    assert W.capture_index(spark.createDataFrame(rows, SCHEMA)).count() == 40


def test_small_payloads_need_not_be_revisits(spark):
    rows = [(1, None, "ab", "x"), (2, None, "ab", "x"), (3, None, "abc", "x"), (4, None, "abc", "x")]
    got = {r.page_id: r.refers_to for r in W.capture_index(spark.createDataFrame(rows, SCHEMA), least_revisit_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    assert W.capture_index(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damaged_archives_are_noticed():
    data = W.record(1, "http://a", W.DATE, b"payload", W.payload_digest(b"payload"), None)
    assert [r[3].endswith(b"payload") for r in W.records(io.BytesIO(data * 3))] == [True] * 3
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(data + data[:-9])))
    wrong = W.record(1, "http://a", W.DATE, b"payload", W.payload_digest(b"other"), None)
    with pytest.raises(ValueError):
        W.capture("f", *next(W.records(io.BytesIO(wrong))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(lists):
    assert list(W.LoserTree([sorted(x) for x in lists])) == sorted(v for x in lists for v in x)


def test_runs_are_read_by_range(tmp_path):
    entries = [[[f"k{i // 3:04d}", "d", False, i, 0, "f"], i] for i in range(2000)]
    with writing(str(tmp_path / "r.run")) as f:
        out = W.RunWriter(f)
        for e in entries:
            out.add(e)
        out.close()
    run = W.Run(str(tmp_path / "r.run"))
    for low, high in ((None, None), (["k0300"], ["k0310"]), (entries[900][0], entries[901][0]), (["z"], None), (None, ["a"]), (entries[1535][0], entries[1537][0])):
        assert list(run.entries(low, high)) == [e for e in entries if (low is None or e[0] >= low) and (high is None or e[0] < high)]


@pytest.mark.parametrize("url, key", [("https://www.Example.com/A?b=C#d", "com,example)/a?b=c"), ("http://a.b:8080", "b,a:8080)/"), (None, ""), ("http://[bad", "http://[bad")])
def test_url_keys(url, key):
    assert W.url_key(url) == key


def test_groups_of_many_runs_are_merged_by_range(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 1000)     # some three records
    rows = [(i, f"http://h{i * 37 % 101}.org/{i % 7}", f"<p>{i}</p>") for i in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "test")
    runs = W.sorted_runs(W.write_archives(frame, folder), folder)
    assert runs.count() > 64
    grouped = W._merge_groups(runs.select("run", "captures", "keys", F.array(F.concat(F.lit('[null,"'), "run", F.lit('"]'))).alias("segments")), folder, 9, 64, 50).collect()
    assert len(grouped) > 1 and max(len(r.segments) for r in grouped) > 3 and sum(r.captures for r in grouped) == 400
    index = sorted(W.merge_runs(runs, folder, range_rows=50).collect(), key=lambda r: (r.range, r.position))
    keys = [(r.url_key, r.date, r.page_id) for r in index]
    assert keys == sorted((W.url_key(u), W.DATE, i) for i, u, _ in rows) and len({r.range for r in index}) > 3


def test_overlapping_segments():
    segments = [[None, "a"], [[3], "b"], [[7], "c"]]
    assert W.overlapping(segments, None, None) == ["a", "b", "c"]
    assert W.overlapping(segments, [3], [7]) == ["b"] and W.overlapping(segments, None, [3]) == ["a"]
    assert W.overlapping(segments, [2], [4]) == ["a", "b"] and W.overlapping(segments, [8], None) == ["c"]
