"""Approximate nearest neighbours by largest inner product with a permutation index.

Each vector is represented by its ``PREFIX`` nearest pivots in order. Vectors are dealt into blocks by hash; in a block every
pivot has an inverted file with the rank it takes for each vector (``PREFIX`` where it is not posted). A query's own
ranking is compared with these by Spearman's footrule; the best ``RERANK`` share of a block is reranked by the exact
inner product in double precision. Query blocks meet index blocks one task each, so that neither grows with the data.

Inner products become nearness by one further coordinate: vectors get sqrt(M^2 - |v|^2), M the largest norm of all, queries 0.
Equal vectors are one class with its ``k + 1`` smallest ids, so copies are neither compared nor shuffled more than once.
Pivots are the ``PIVOTS`` classes that come first by a hash of their id.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_k
from .common import stored

PIVOTS, PREFIX = 128, 64
RERANK, RERANK_LEAST = 0.4, 400     # share of a block that is reranked, and how many at least
INDEX_ROWS, QUERY_ROWS = 16_384, 2_048


def rankings(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest pivots in order, rank of each pivot or ``prefix``) per vector; ties go to the smaller pivot number."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]
    ranks = np.full((len(vectors), len(pivots)), prefix, np.int16)
    np.put_along_axis(ranks, order, np.arange(order.shape[1], dtype=np.int16)[None, :], 1)
    return order, ranks


def search_block(index: np.ndarray, ids: list[list[int]], queries: np.ndarray, pivots: np.ndarray, largest: float, keep: int,
                 prefix: int = PREFIX, rerank: float = RERANK):
    """For each query the (score, id) of its best ``keep`` rows of the block, best first."""
    norms = np.sqrt(np.maximum(largest * largest - (index * index).sum(axis=1), 0))
    files = np.ascontiguousarray(rankings(np.column_stack([index, norms]), pivots, prefix)[1].T)
    order, _ = rankings(np.column_stack([queries, np.zeros(len(queries))]), pivots, prefix)
    places = np.arange(order.shape[1], dtype=np.int16)[:, None]
    take = min(len(index), max(RERANK_LEAST, math.ceil(rerank * len(index))))
    for q, own in zip(queries, order):
        if take < len(index):
            footrule = np.abs(files[own] - places).sum(axis=0, dtype=np.int32)
            near = np.argpartition(footrule, take - 1)[:take]
        else:
            near = np.arange(len(index))
        rough = index[near] @ q
        if len(near) > 2 * keep:
            near = near[np.argpartition(-rough, 2 * keep)[:2 * keep]]
        scores = (index[near] * q).sum(axis=1)
        if len(near) > keep:
            least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
            near, scores = near[scores >= least], scores[scores >= least]
        found = sorted((-s, i) for s, n in zip(scores.tolist(), near.tolist()) for i in ids[n])
        yield [(-s, i) for s, i in found[:keep]]


def nearest(embeddings: DataFrame, is_query: Callable[[Column], Column], k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
            index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the ``k`` nearest found for each row where ``is_query`` (a function of the id column) holds.

    Rows with a null id, or a vector that is null, empty, zero or holds a null or non-finite component, take no part. Repeated rows
    count once; an id with several vectors takes the smallest. Only vectors of a query's own length are its
    candidates, and never its own row. Ties go to the smaller id. No rows give no rows.
    """
    spark = embeddings.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = stored(embeddings.filter(sound).select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v")).withColumn("q", F.coalesce(is_query(F.col("id")), F.lit(False))), "vectors")
    heads = rows.groupBy("v").agg(F.min("id").alias("class"), F.max("q").alias("q"))
    members = top_k(rows.select("v", "id"), ["v"], ["id"], k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(heads.join(members, "v").withColumn("dim", F.size("v")), "classes")
    stats = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("nq"),
                                       F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest")).filter("nq > 0")
    shapes = {r["dim"]: r for r in stats.collect()}
    first = top_k(classes.select("dim", "class", "v"), ["dim"], [F.xxhash64("class"), "class"], pivots)
    anchors: dict[int, list] = {}
    for r in first.filter(F.col("dim").isin(list(shapes) or [-1])).collect():
        anchors.setdefault(r["dim"], []).append(np.array(r["v"]))
    setting = {}
    for dim, r in shapes.items():
        p, largest = np.array(anchors[dim]), r["largest"] * (1 + 1e-12)
        setting[dim] = (np.column_stack([p, np.sqrt(np.maximum(largest ** 2 - (p * p).sum(axis=1), 0))]), largest)
    setting = spark.sparkContext.broadcast(setting)

    def blocks_of(column: str, rows_each: int):
        out = F.lit(1)
        for dim, r in shapes.items():
            out = F.when(F.col("dim") == dim, F.lit(max(1, math.ceil(r[column] / rows_each)))).otherwise(out)
        return out

    known = classes.filter(F.col("dim").isin(list(shapes) or [-1])).withColumn("nb", blocks_of("n", index_rows)).withColumn("nq", blocks_of("nq", query_rows))
    h = F.xxhash64("class")
    def spread(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    index = known.select("dim", F.pmod(h, F.col("nb")).cast("int").alias("b"), spread("nq").alias("qb"), "ids", "v")
    asked = known.filter("q").select("dim", spread("nb").alias("b"), F.pmod(h, F.col("nq")).cast("int").alias("qb"), "class", "v")

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            anchors, largest = setting.value[int(key[0])]
            found = search_block(np.stack(left["v"].to_numpy()).astype(np.float64), [list(map(int, i)) for i in left["ids"]], np.stack(right["v"].to_numpy()).astype(np.float64), anchors, largest, k + 1, prefix, rerank)
            out = [(int(c), i, s) for c, near in zip(right["class"], found) for s, i in near]
        return pd.DataFrame(out, columns=["class", "vec_id", "score"]).astype({"class": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "b", "qb"]
    met = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "class long, vec_id long, score double")
    best = top_k(met, ["class"], [F.desc("score"), "vec_id"], k + 1).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    queries = rows.filter("q").join(classes.select("v", "class"), "v").select(F.col("id").alias("query_id"), "class").join(best, "class")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.select("query_id", F.posexplode(others).alias("at", "x")).select(
        F.col("query_id").cast("long"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").cast("long").alias("vec_id"), F.col("x.score").alias("score"))
