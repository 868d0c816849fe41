"""Blocks of vectors with angular bounds, for exact nearest rows by cosine.

Rows are grouped by the nearest of a bounded number of pivots and split into blocks of bounded size. For every pivot the widest angle to one of its rows is
known, so the cosine between a query and a row of the pivot is at most cos(angle to the pivot - widest angle). A query first meets the pivots with
the highest bounds, then those whose bound reaches its k-th best similarity so far. Unstructured vectors leave nothing out and are still exact.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import top_k

BLOCK_ROWS = 2_048
PIVOTS = 256
FIRST_ROWS = 8_192
NEAR = 1e-8  # similarities are compared to nine decimals


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


@dataclass(frozen=True)
class VectorIndex:
    """rows: (person_id, block, ..., embedding). A block is a number; ``shared`` holds per vector length the pivots, their widest angles, row counts
    and first block numbers. Rows of norm zero lie with the pivot of number 0, whose angle bounds nothing."""
    rows: DataFrame
    shared: Broadcast

    def _visits(self, queries: DataFrame, bars: DataFrame | None, first_rows: int) -> DataFrame:
        shared, barred = self.shared, bars is not None

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, blocks = [], []
                bar_of = batch.column(3).to_pylist() if barred else [None] * batch.num_rows
                for query, dim, vector, bar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), bar_of):
                    if dim not in shared.value:
                        continue
                    pivots, widest, counts, starts = shared.value[dim]
                    q = _unit(np.array([vector], np.float64))[0]
                    bounds = np.cos(np.maximum(np.arccos(np.clip(pivots @ q, -1, 1)) - widest - 1e-9, 0)) if q.any() else np.ones(len(pivots))
                    bounds[0] = max(bounds[0], 0.0)
                    order = np.argsort(-bounds, kind="stable")
                    before = np.cumsum(counts[order]) - counts[order]
                    early = before < first_rows
                    taken = order[early] if not barred else order[~early & (bounds[order] >= (-2 if bar is None else bar - NEAR))]
                    for p in taken:
                        blocks += range(starts[p], starts[p + 1])
                        ids += [query] * (starts[p + 1] - starts[p])
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(blocks, pa.int32())], names=["query_id", "block"])

        columns = ["query_id", "dim", "embedding"]
        asked = queries.select(*columns) if bars is None else queries.select(*columns).join(bars, "query_id", "left").select(*columns, "bar")
        return asked.mapInArrow(visit, f"query_id {queries.schema['query_id'].dataType.simpleString()}, block int")

    def nearest(self, queries: DataFrame, first_rows: int = FIRST_ROWS) -> DataFrame:
        """(query_id, block): the blocks of the pivots with the highest bounds, until they hold ``first_rows`` rows."""
        return self._visits(queries, None, first_rows)

    def further(self, queries: DataFrame, hits: DataFrame, k: int, first_rows: int = FIRST_ROWS) -> DataFrame:
        """(query_id, block): all other blocks that may hold a row as good as the ``k``-th of ``hits``; all of them if there are fewer."""
        bars = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank_score").alias("bar")).filter(F.col("n") >= k).drop("n")
        return self._visits(queries, bars, first_rows)


def build_vectors(rows: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """rows: (person_id, embedding, ...). Null or empty vectors and those with null or non-finite components take no part.

    Pivots are the vectors that come first by a hash of the id, at most ``pivots`` per vector length, and one for every ``block_rows`` rows.
    """
    spark = rows.sparkSession
    sound = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = stored(rows.filter(sound).withColumn("dim", F.size("embedding")), "vectors")
    sizes = {r["dim"]: r["count"] for r in base.groupBy("dim").count().collect()}
    first = top_k(base.select("dim", "person_id", "embedding"), ["dim"], [F.xxhash64("person_id"), "person_id"], pivots, "place")
    drawn: dict[int, list] = {}
    for r in first.sort("dim", "place").collect():  # at most ``pivots`` rows per vector length
        if r["place"] <= max(1, sizes[r["dim"]] // block_rows):
            drawn.setdefault(r["dim"], []).append(r["embedding"])
    centres = spark.sparkContext.broadcast({dim: _unit(np.array(v, np.float64)) for dim, v in drawn.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, column = np.asarray(batch.column(batch.schema.get_field_index("dim"))), batch.column(batch.schema.get_field_index("embedding"))
            pivot, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cosines = _unit(_matrix(column.take(pa.array(at)), int(dim))) @ centres.value[int(dim)].T
                pivot[at] = np.argmax(cosines, axis=1)
                angle[at] = np.arccos(np.clip(cosines[np.arange(len(at)), pivot[at]], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(angle)], names=[*batch.schema.names, "pivot", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    placed = stored(base.mapInArrow(place, kinds + ", pivot int, angle double"), "placed-vectors")
    found = {dim: (np.zeros(len(v)), np.zeros(len(v), np.int64)) for dim, v in centres.value.items()}
    for r in placed.groupBy("dim", "pivot").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():
        found[r["dim"]][0][r["pivot"]], found[r["dim"]][1][r["pivot"]] = r["angle"], r["n"]
    shared, start, first_block, splits = {}, 0, [], []
    for dim, (widest, counts) in found.items():
        parts = -(-counts // block_rows)
        starts = start + np.concatenate([[0], np.cumsum(parts)])
        start = int(starts[-1])
        shared[dim] = (centres.value[dim], widest, counts, starts.tolist())
        first_block += [x for p in range(len(counts)) for x in (F.lit(f"{dim}:{p}"), F.lit(int(starts[p])))]
        splits += [x for p in range(len(counts)) if parts[p] > 1 for x in (F.lit(f"{dim}:{p}"), F.lit(int(parts[p])))]
    key = F.concat_ws(":", "dim", "pivot")
    table = lambda cells: F.element_at(F.create_map(*cells), key) if cells else F.lit(None).cast("int")
    block = table(first_block) + F.pmod(F.xxhash64("person_id"), F.coalesce(table(splits), F.lit(1)))
    return VectorIndex(placed.withColumn("block", block.cast("int")).drop("pivot", "angle", "dim"), spark.sparkContext.broadcast(shared))
