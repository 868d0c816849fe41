"""Vocabularies given as tables rather than as Python values."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .automaton import Automaton


MOST_PATTERNS = 10_000


def vocabulary_dict(table: DataFrame, most: int = MOST_PATTERNS) -> dict[str, list[str]]:
    """(canonical, pattern) rows -> dict for the column operators, which put the patterns into the plan.

    More than ``most`` distinct rows are an error: they would not fit a plan. A larger vocabulary stays a table, for ``table_hits``.
    """
    rows = table.select("canonical", "pattern").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns; use table_hits")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["canonical"], r["pattern"])):
        out.setdefault(r["canonical"], []).append(r["pattern"])
    return out


BLOCK_PATTERNS, BLOCK_CHARS = 50_000, 1 << 20


def pattern_blocks(vocabulary: DataFrame, most: int = BLOCK_PATTERNS, chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """(block, pattern, canonicals) with lower-case patterns dealt by hash into blocks of about ``most`` patterns and ``chars`` characters, and the count of blocks."""
    v = vocabulary.select("canonical", F.lower("pattern").alias("pattern")).filter("pattern <> ''").groupBy("pattern").agg(F.collect_set("canonical").alias("canonicals"))
    v = stored(v, "patterns")
    n, size = v.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    blocks = max(-(-n // most), -(-size // chars))
    return v.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(max(blocks, 1)))), blocks


def table_hits(texts: DataFrame, vocabulary: DataFrame, most: int = BLOCK_PATTERNS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(row_id, text) x (canonical, pattern) -> distinct (row_id, canonical) of patterns occurring in the text.

    Any vocabulary size: patterns lie in blocks of bounded size, each of which is broadcast and made into one automaton per worker, and every text passes by
    each block once, without a shuffle. No piece of a text is a join key, so frequent ones cost nothing. Null texts hold nothing.
    """
    patterns, blocks = pattern_blocks(vocabulary, most, chars)
    low = texts.select("row_id", F.lower("text").alias("text"))
    schema = f"row_id {texts.schema['row_id'].dataType.simpleString()}, canonical string"
    out = texts.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        rows = [(r["pattern"], r["canonicals"]) for r in patterns.filter(F.col("block") == block).collect()]  # about ``most`` rows
        shared = texts.sparkSession.sparkContext.broadcast(rows)

        def find(batches, shared=shared):
            automaton, canonicals = Automaton([p for p, _ in shared.value]), [c for _, c in shared.value]
            for batch in batches:
                ids, names = [], []
                for at, text in enumerate(batch.column(1).to_pylist()):
                    found = {c for p in automaton.found(text or "") for c in canonicals[p]}
                    ids += [at] * len(found)
                    names += found
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string())], names=["row_id", "canonical"])

        out = out.unionByName(low.mapInArrow(find, schema))
    return out.distinct()
