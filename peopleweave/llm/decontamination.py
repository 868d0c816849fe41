"""Benchmark decontamination: Wu-Manber search for many word sequences at once.

Patterns are the windows of the benchmark items. Within one pattern length m, a table of blocks (two consecutive words)
tells how far the search may jump, buckets by the last block and then by the first block select patterns, and a
direct comparison confirms. Short items form classes of their own length.

The benchmark is cut into blocks of at most about ``block_bytes`` of text. A benchmark of one block is broadcast, and every document meets it
inside its task. A larger one lies in the shared folder by block: the documents pass one block after another, so that only one
block is broadcast at a time and a task builds its matcher once, and the places that were hit are added up by document.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored, utf8, with_results

WINDOW = 10
BLOCK_BYTES = 2 << 20   # text of benchmark items in one broadcast
CHUNK_WORDS = 4096      # an item longer than this is cut into overlapping chunks with the same windows

RESULTS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "strings", "items_sha256": "string", "contaminated": "boolean"}

# Bytes to the lower-case word byte they stand for, or to a space.
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return raw.translate(_FOLD).split() if raw else []


class WuManber:
    """Finds all occurrences of word sequences of one length."""

    def __init__(self, patterns: dict[tuple, list]):
        self.patterns = patterns
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.free = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b:end]
                self.shift[key] = min(self.shift.get(key, self.free), m - end)
            self.buckets.setdefault(p[m - b:], {}).setdefault(p[:b], []).append(p)

    def find(self, words: list[bytes]):
        """(start, payload) of each occurrence."""
        m, b, shift, free, buckets, patterns = self.length, self.block, self.shift, self.free, self.buckets, self.patterns
        at, n = m, len(words)
        while at <= n:
            key = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            jump = shift.get(key, free)
            if jump:
                at += jump
                continue
            start = at - m
            selected = buckets[key].get(tuple(words[start:start + b]))
            if selected:
                window = tuple(words[start:at])
                if len(selected) < 8:
                    for p in selected:
                        if p == window:
                            yield start, patterns[p]
                elif window in patterns:
                    yield start, patterns[window]
            at += 1


def matchers(chunks: list[tuple[str | None, list[bytes]]], window: int) -> list[WuManber]:
    """One matcher per pattern length from (item id, words) chunks."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, words in chunks:
        m = min(window, len(words))
        found = by_length.setdefault(m, {})
        for start in range(len(words) - m + 1):
            ids = found.setdefault(tuple(words[start:start + m]), [])
            if item is not None and item not in ids[-1:]:
                ids.append(item)
    return [WuManber(p) for m, p in sorted(by_length.items()) if m]


def marks(words: list[bytes], blocks) -> tuple[bytearray, set]:
    """(1 for each word hit, ids of items with an occurring window) over the given pattern blocks."""
    hit, items = bytearray(len(words)), set()
    for found in blocks:
        for matcher in found:
            m = matcher.length
            for start, ids in matcher.find(words):
                hit[start:start + m] = b"\1" * m
                items.update(ids)
    return hit, items


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Callable]:
    """(number of blocks, function from a number to that block's (item id, text of a chunk of words)); the driver holds one block at a time."""
    step = CHUNK_WORDS
    # Chunks overlap by window - 1 words, so that each window lies in exactly one.
    words = F.filter(F.split(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - F.lit(window)), F.lit(step))
    rows = rows.select("item", "w", F.explode(starts).alias("s"))
    rows = rows.select("item", F.array_join(F.slice("w", F.col("s") + 1, F.lit(step + window - 1)), " ").alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    count = max(1, math.ceil(1.25 * size / block_bytes))
    if count > 1:
        path = shared_folder(benchmark.sparkSession, "benchmark")
        rows.withColumn("b", F.pmod(F.xxhash64("item", "t"), F.lit(count))).repartition("b").write.partitionBy("b").parquet(path)
        rows = benchmark.sparkSession.read.schema("item string, t string, b long").parquet(path)
    return count, lambda b: [(r["item"], r["t"].encode()) for r in (rows.filter(F.col("b") == b) if count > 1 else rows).select("item", "t").collect()]


def _results(n_words: list, n_hit: list, items: list) -> list:
    """Result columns from the words, the words hit and the ids of the items of each document."""
    ids = [sorted(i) for i in items]
    return [n_words, n_hit, [len(i) for i in ids], ids, [hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], [h > 0 for h in n_hit]]


def _runs(hit: bytearray) -> list[int]:
    """Begins and ends of the runs of ones, alternating."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out += [at, end]
        at = hit.find(1, end)
    return out


def _covered(runs: list[int]) -> int:
    """Places covered by runs (begins and ends, alternating) that may overlap."""
    total, upto = 0, 0
    for begin, end in sorted(zip(runs[::2], runs[1::2])):
        total += max(0, end - max(begin, upto))
        upto = max(upto, end)
    return total


def _in_passes(docs: DataFrame, text_col: str, count: int, block_of: Callable, window: int, kept: list[str]) -> DataFrame:
    """``find_contamination`` for a benchmark of several blocks.

    Rows get a number in a written table, so that a repeated task finds the same one. Each pass writes the documents that a block has hit
    (the first also the number of words of all); what is gathered of a document is bounded by its own words and items.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "hits")
    numbered = stored(docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], utf8(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row")), "documents")
    for b in range(count):
        block = spark.sparkContext.broadcast(block_of(b))

        def start(block=block):
            found = matchers([(item, text.split(b" ")) for item, text in block.value], window)

            def work(columns):
                words, runs, items = [words_of(t) for t in columns["text"]], [], []
                for w in words:
                    hit, ids = marks(w, [found])
                    runs.append(_runs(hit))
                    items.append(sorted(ids))
                return [list(map(len, words)), runs, items]

            return work

        passed = with_results(numbered, {"text": F.col("__text")}, start, {"n": "long", "runs": "longs", "items": "strings"}, keep=["__row"])
        if b:
            passed = passed.filter(F.size("runs") > 0).withColumn("n", F.lit(0).cast("long"))
        passed.write.parquet(f"{folder}/b={b}")
        block.destroy()
    hits = spark.read.schema("__row long, n long, runs array<bigint>, items array<string>").parquet(*[f"{folder}/b={b}" for b in range(count)])
    hits = hits.groupBy("__row").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    found = numbered.drop("__text").join(hits, "__row")
    out = with_results(found, {"n": F.col("n"), "runs": F.col("runs"), "items": F.col("items")},
                       lambda: lambda columns: _results(columns["n"], list(map(_covered, columns["runs"])), columns["items"]), RESULTS, keep=[f"__k{i}" for i in range(len(kept))])
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], *RESULTS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids as strings), items_sha256 and contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null or
    empty texts have no words; items without words match nothing. An item with a null id marks words as hit but has no id
    to count. Repeated item rows count once, repeated documents each get their row. Kept columns with a result's name are
    replaced. Without benchmark rows nothing is hit.
    """
    count, block_of = benchmark_blocks(benchmark, item_id, item_text, window, block_bytes)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    if count > 1:
        return _in_passes(docs, text_col, count, block_of, window, kept)
    block = docs.sparkSession.sparkContext.broadcast(block_of(0))

    def start():
        found = [matchers([(item, text.split(b" ")) for item, text in block.value], window)]

        def work(columns):
            words = [words_of(t) for t in columns["text"]]
            hits = [marks(w, found) for w in words]
            return _results(list(map(len, words)), [hit.count(1) for hit, _ in hits], [items for _, items in hits])

        return work

    return with_results(docs, {"text": utf8(text_col)}, start, RESULTS, kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    marked = find_contamination(docs.withColumns({"__c_" + c: docs[c] for c in RESULTS if c in docs.columns}),
                                benchmark, **options).filter(~F.col("contaminated"))
    return marked.select(*[F.col("__c_" + c).alias(c) if "__c_" + c in marked.columns else F.col(c) for c in docs.columns])
