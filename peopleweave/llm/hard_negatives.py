"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves; each half-space has its own codebook, and a pair of half codewords is a cell. The best score that a cell can hold
for an anchor is the sum of two half-score bounds, one per codeword: product with the codeword plus norm times its radius. A multi-sequence
heap hands out the cells of an anchor by falling bound. An anchor first visits cells until they hold ``FIRST_ROWS`` rows; what it found there
gives a bar for each of its windows, and it then visits every further cell whose bound reaches the least bar. Below that no cell can
change a window, so the windows are certified and the results exact.

Positives are one window over rows of the same label, negatives one window per positive over rows of other labels. Cells lie in Spark tables
dealt by their first codeword and split by row; anchors that begin in the same cell travel together, and rows only meet anchors that ask for them.
Codebooks are fitted on at most ``FIT_ROWS`` rows chosen by hash and have about the fourth root of the row count in words, ``MOST_WORDS`` at
most, so the broadcast model is bounded by these parameters.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_k
from .common import stored

FIT_ROWS, MOST_WORDS, ROUNDS = 8_192, 256, 8
FIRST_ROWS = 2_048                        # rows in the cells of an anchor's first visit
PART_ROWS, CHUNK_ROWS = 4_096, 1_024      # rows and anchors that meet in one task at a time
FAR = 2 ** 62


def fit_words(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords of a half-space by Lloyd rounds from evenly picked distinct points; fewer points give fewer words."""
    words = np.unique(points, axis=0) if points.shape[1] else points[:1]
    words = words[np.linspace(0, len(words) - 1, min(count, len(words))).astype(int)]
    for _ in range(rounds):
        near = nearest_words(points, words)[0]
        sums, sizes = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, points)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return words


def nearest_words(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest word, distance to it) per point; ties go to the smaller number."""
    near = np.argmin((words * words).sum(axis=1) - 2 * points @ words.T, axis=1)
    return near, np.sqrt(((points - words[near]) ** 2).sum(axis=1))


def half_bounds(query: np.ndarray, words: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest product that a row of each half codeword can have with the query's half, rounded up."""
    norm = math.sqrt(float(query @ query))
    bounds = words @ query + norm * radii
    return bounds + 1e-9 * (np.abs(words) @ np.abs(query) + norm * radii) + 1e-6


def visit(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, first word, second word) of all cells by falling bound: a multi-sequence heap over two sorted lists."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, reached = [(-(first[a[0]] + second[b[0]]), 0, 0)], [0] * len(a)
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:     # a cell enters once its left and upper neighbours are out
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[j]]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))


def best_in_windows(scores: np.ndarray, allowed: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of the ``keep`` best allowed scores of each row; ties go to the column on the left."""
    rows = np.flatnonzero(allowed.any(axis=1))
    if not len(rows):
        return rows, rows
    allowed = allowed[rows]
    if allowed.shape[1] > keep:
        shown = np.where(allowed, scores[rows], -np.inf)
        least = np.partition(shown, shown.shape[1] - keep, axis=1)[:, [shown.shape[1] - keep]]
        above, level = shown > least, (shown == least) & allowed
        allowed = above | (level & (np.cumsum(level, axis=1) <= keep - above.sum(axis=1, keepdims=True)))
    r, c = np.nonzero(allowed)
    return rows[r], c


class Codebooks:
    """Half codewords, their radii and the number of rows in each cell, for vectors of one length."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray]):
        self.words, self.cut = words, words[0].shape[1]
        self.radii = (np.zeros(len(words[0])), np.zeros(len(words[1])))
        self.rows = np.zeros((len(words[0]), len(words[1])), np.int64)
        self.anchors = np.zeros(len(words[0]), np.int64)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[..., :self.cut], vectors[..., self.cut:]

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        one, two = (half_bounds(q, w, r) for q, w, r in zip(self.halves(query), self.words, self.radii))
        return visit(one, two)

    def wanted(self, query: np.ndarray, skip: int, bar: float | None, first_rows: int) -> tuple[int, dict[int, list[int]]]:
        """(cells popped, filled cells to visit by first codeword): up to ``first_rows`` rows, or after ``skip`` cells all that reach ``bar``."""
        popped, held, out = 0, 0, {}
        for bound, i, j in self.cells(query):
            if (held >= first_rows) if bar is None else (bound < bar):
                break
            popped += 1
            if popped > skip and self.rows[i, j]:
                held += int(self.rows[i, j])
                out.setdefault(i, []).append(j)
        return popped, out


def _matrix(values, dim: int) -> np.ndarray:
    return np.array(values.tolist(), np.float64).reshape(len(values), dim)


def _fit(rows: DataFrame, fit_rows: int, most_words: int) -> dict[int, Codebooks]:
    """Codebooks for each vector length that an anchor has."""
    stats = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("anchor").alias("anchor")).filter("anchor")
    sizes = {r["dim"]: r["n"] for r in stats.collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, min(1.0, fit_rows / n))])
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    drawn: dict[int, list] = {}
    for r in rows.filter(h < F.element_at(share, F.col("dim")) * F.lit(float(1 << 31))).select("dim", "id", "v").sort(h, "id").collect():
        drawn.setdefault(r["dim"], []).append(r["v"])
    books = {}
    for dim, n in sizes.items():
        points = drawn.get(dim, [[0.0] * dim])[:fit_rows]
        points = np.array(points, np.float64).reshape(len(points), dim)
        count = max(2, min(most_words, round(n ** 0.25)))
        books[dim] = Codebooks((fit_words(points[:, :dim // 2], count), fit_words(points[:, dim // 2:], count)))
    return books


def _place(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """Rows with the two codewords (c1, c2) of their cell and the distances (d1, d2) to them."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def place(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                book = shared.value[int(dim)]
                for k, (half, words) in enumerate(zip(book.halves(_matrix(part["v"], int(dim))), book.words), 1):
                    near, far = nearest_words(half, words)
                    part = part.assign(**{f"c{k}": near.astype(np.int32), f"d{k}": far})
                yield part
    return rows.mapInPandas(place, "dim int, id long, label long, v array<double>, anchor boolean, c1 int, c2 int, d1 double, d2 double")


def _measure(cells: DataFrame, books: dict[int, Codebooks]) -> None:
    """Fill in radii and cell sizes; at most MOST_WORDS ** 2 figures per vector length come to the driver."""
    for r in cells.groupBy("dim", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():
        book = books[r["dim"]]
        book.anchors[r["c1"]] += r["anchors"]
        book.rows[r["c1"], r["c2"]] = r["n"]
        for k, radii in enumerate(book.radii, 1):
            radii[r[f"c{k}"]] = max(radii[r[f"c{k}"]], r[f"d{k}"] * (1 + 1e-9))


def _chunks(books: dict[int, Codebooks], most: int) -> tuple[dict, dict]:
    """First chunk number and count of chunks of the anchors of each (length, first codeword): small cells share a chunk, large ones are split."""
    starts, splits, chunk, held = {}, {}, 0, 0
    for dim, book in books.items():
        chunk, held = chunk + (held > 0), 0
        for c1, n in enumerate(book.anchors.tolist()):
            if held and held + n > most:
                chunk, held = chunk + 1, 0
            starts[dim, c1], splits[dim, c1] = chunk, max(1, -(-n // most))
            held += n
            if splits[dim, c1] > 1:
                chunk, held = chunk + splits[dim, c1], 0
    return starts, splits


def _lookup(values: dict, other: int) -> Column:
    """A small table by (length, first codeword) as a column; values equal to ``other`` need no entry."""
    shown = [F.lit(x) for (dim, c1), v in values.items() if v != other for x in (f"{dim}:{c1}", int(v))]
    if not shown:
        return F.lit(other)
    return F.coalesce(F.element_at(F.create_map(*shown), F.concat_ws(":", "dim", "c1")), F.lit(other))


_ASKED = "dim int, chunk int, id long, label long, v array<double>, lows array<long>, highs array<long>, bars array<long>, popped int, c1 int, part int, twos array<int>"


def _search(cells: DataFrame, anchors: DataFrame, shared, same: bool, keep: int, first_rows: int, part_rows: int) -> DataFrame:
    """(id, window, found, score): for each anchor and window (lows, highs) its ``keep`` best rows, of its own label or of other labels.

    ``anchors`` holds dim, chunk, id, label, v, lows and highs.
    """
    def ask(second: bool):
        def run(frames):
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    book, bars = shared.value[row.dim], list(row.bars) if second else []
                    open_bars = [bar for bar, low, high in zip(bars or row.lows, row.lows, row.highs) if low <= high]
                    if not open_bars:
                        continue
                    popped, wanted = book.wanted(np.array(row.v, np.float64), row.popped if second else 0, min(open_bars) if second else None, first_rows)
                    for c1, twos in wanted.items():
                        parts = -(-int(book.rows[c1].sum()) // part_rows)
                        out += [(row.dim, row.chunk, row.id, row.label, row.v, row.lows, row.highs, bars, popped, c1, p, twos) for p in range(parts)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _ASKED.split(", ")])
        return run

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, windows, found, scores = [], [], [], []
        if len(left) and len(right):
            dim, left = int(key[0]), left.sort_values("id")
            index, of, labels, twos = _matrix(left["v"], dim), left["id"].to_numpy(), left["label"].to_numpy(), left["c2"].to_numpy()
            for at in range(0, len(right), CHUNK_ROWS):
                asked = right.iloc[at:at + CHUNK_ROWS]
                wants = np.zeros((len(asked), shared.value[dim].rows.shape[1]), bool)
                for i, cells_wanted in enumerate(asked["twos"]):
                    wants[i, np.asarray(cells_wanted, int)] = True
                own = asked["id"].to_numpy()
                open_ = wants[:, twos] & ((asked["label"].to_numpy()[:, None] == labels[None, :]) == same) & (own[:, None] != of[None, :])
                product = _matrix(asked["v"], dim) @ index.T
                lows, highs, bars = ([list(x) for x in asked[c]] for c in ("lows", "highs", "bars"))
                for w in range(max(map(len, lows))):
                    low = np.array([max(x[w], b[w] if b else -FAR) if w < len(x) else FAR for x, b in zip(lows, bars)], np.float64)
                    high = np.array([x[w] if w < len(x) else -FAR for x in highs], np.float64)
                    r, c = best_in_windows(product, open_ & (product >= low[:, None]) & (product <= high[:, None]), keep)
                    ids.append(own[r]), windows.append(np.full(len(r), w)), found.append(of[c]), scores.append(product[r, c])
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pd.DataFrame({"id": cat(ids, "int64"), "window": cat(windows, "int32"), "found": cat(found, "int64"),
                             "score": np.clip(cat(scores, "float64"), -2.0 ** 62, 2.0 ** 62).astype("int64")})

    def met(asked: DataFrame) -> DataFrame:
        keys = ["dim", "c1", "part", "chunk"]
        pairs = asked.select(*[F.col(k).alias(k) for k in keys]).distinct()
        index = cells.join(pairs, keys[:3]).select(*keys, "id", "label", "v", "c2")
        hits = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "id long, window int, found long, score long")
        return top_k(hits, ["id", "window"], [F.desc("score"), "found"], keep)

    state = anchors.withColumns({"bars": F.lit(None).cast("array<long>"), "popped": F.lit(0)})
    first_asked = stored(state.mapInPandas(ask(False), _ASKED), "first-cells")
    first = stored(met(first_asked), "first-windows")
    # A full window bars rows below its last one; a window that is not full yet is open down to its low end.
    full = first.groupBy("id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= keep)
    least = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("least"))
    popped = first_asked.groupBy("id").agg(F.max("popped").alias("popped"))
    bars = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.element_at(F.coalesce("least", F.create_map().cast("map<int,bigint>")), w), low)))
    state = anchors.join(least, "id", "left").join(popped, "id", "left").withColumns({"bars": bars, "popped": F.coalesce("popped", F.lit(0))}).drop("least")
    second = met(stored(state.mapInPandas(ask(True), _ASKED), "further-cells"))
    return top_k(first.drop("rank").unionByName(second.drop("rank")), ["id", "window"], [F.desc("score"), "found"], keep)


def mine(embeddings: DataFrame, is_anchor: Callable[[Column], Column], *, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, fit_rows: int = FIT_ROWS,
         most_words: int = MOST_WORDS, first_rows: int = FIRST_ROWS, part_rows: int = PART_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the ``negatives`` hardest rows of other labels for each anchor
    and positive, whose score is between ``low`` and ``high`` hundredths of the positive's.

    Components become floor(scale * x); a score is their integer product, exact below 2 ** 53. Rows with a null id, label or vector, or a null
    or non-finite component take no part. Repeated ids count once, with the least label and vector. Only vectors of an anchor's own length
    are its candidates, and never its own row; equal scores go to the smaller id. Anchors without a positive, positives without a
    row in their window and empty tables give no rows. Other columns play no part.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    mark = (F.col("label") if label is None else label).cast("long")
    sound = F.col(f"`{id_col}`").isNotNull() & mark.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floored = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    rows = embeddings.filter(sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.struct(mark.alias("label"), floored.alias("v")).alias("row"))
    rows = rows.groupBy("id").agg(F.min("row").alias("row"))
    rows = stored(rows.select(F.size("row.v").alias("dim"), "id", "row.label", "row.v", F.coalesce(is_anchor(F.col("id")), F.lit(False)).alias("anchor")), "vectors")
    books = _fit(rows, fit_rows, most_words)
    lengths = rows.filter(F.col("dim").isin(list(books) or [-1]))
    cells = stored(_place(lengths, books), "cells")
    _measure(cells, books)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    h = F.xxhash64("id")
    cells = cells.withColumn("part", F.pmod(h, _lookup({(dim, c1): -(-int(n) // part_rows) for dim, book in books.items() for c1, n in enumerate(book.rows.sum(axis=1))}, 1)).cast("int"))
    starts, splits = _chunks(books, chunk_rows)
    chunk = _lookup(starts, 0) + F.pmod(h, _lookup(splits, 1))
    anchors = stored(cells.filter("anchor").select("dim", chunk.cast("int").alias("chunk"), "id", "label", "v"), "anchors")

    everything = {"lows": F.array(F.lit(-FAR)), "highs": F.array(F.lit(FAR))}
    near = stored(_search(cells, anchors.withColumns(everything), shared, True, positives, first_rows, part_rows), "positives")
    found = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found").alias("positive"), F.col("score").alias("p")))).alias("near"))
    ends = {"lows": F.transform("near", lambda x: F.ceil(x["p"] * low / F.lit(100)).cast("long")), "highs": F.transform("near", lambda x: F.floor(x["p"] * high / F.lit(100)).cast("long"))}
    asked = stored(anchors.join(found, "id").withColumns(ends), "negatives-asked")
    hard = _search(cells, asked.drop("near"), shared, False, negatives, first_rows, part_rows)
    pair = F.element_at("near", F.col("window") + 1)
    return hard.join(found, "id").select(F.col("id").alias("anchor_id"), pair["positive"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                         F.col("found").alias("negative_id"), pair["p"].alias("positive_score"), F.col("score").alias("negative_score"))
