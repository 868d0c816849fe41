"""Exact per-query top-k where tiles of queries meet blocks of rows.

Rows lie in blocks, queries in tiles, both tables in Spark. A table of (query, block) pairs, made from an inverted index or from bounds, says who
has to meet; a block and the queries of a tile that want it come together in one cogroup, which multiplies them and keeps the k best
rows per query. So k rows per query and block are shuffled, nothing passes through the driver, and blocks that no query wants are never read.
"""
from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import top_k

TILE_QUERIES = 1024
CELLS, TERM_CELLS = 1_000_000, 4_000_000  # cells of one (rows x queries) and one (rows x terms) block
_INNER = re.compile(r"(?=([^\W_]{3}))")


def gram_code(gram: str) -> int:
    """Three code points as one whole number."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def gram_lists(packed: pa.BinaryArray) -> pa.ListArray:
    """Lists of gram codes from their packed bytes."""
    sizes = np.asarray(pc.binary_length(packed)) // 8
    codes = np.frombuffer(b"".join(packed.to_pylist()), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(codes))


def tiled(queries: DataFrame, size: int = TILE_QUERIES) -> DataFrame:
    """Queries with a ``tile`` number; a tile holds about ``size`` of them."""
    n = max(1, -(-queries.count() // size))
    return queries.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))


class TermMatrix:
    """Query terms of one channel as a 0/1 matrix; rows of the table are matched against its vocabulary."""

    def __init__(self, term_lists, kind: pa.DataType = pa.string()):
        vocabulary = sorted({t for terms in term_lists for t in terms})
        index = {t: i for i, t in enumerate(vocabulary)}
        self.values = pa.array(vocabulary, kind)
        self.weights = np.zeros((len(vocabulary), len(term_lists)), dtype=np.float32)
        for q, terms in enumerate(term_lists):
            for t in terms:
                self.weights[index[t], q] = 1.0
        self.needed = self.weights.sum(axis=0)

    def occurrences(self, lists: pa.ListArray) -> np.ndarray:
        """1 where a row holds a term, per (row, term)."""
        rows = np.zeros((len(lists), len(self.values)), dtype=np.float32)
        where = pc.index_in(lists.flatten(), value_set=self.values)
        parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        ids = where.fill_null(-1).to_numpy(zero_copy_only=False)
        known = ids >= 0
        rows[parents[known], ids[known]] = 1.0
        return rows

    def overlap(self, lists: pa.ListArray) -> np.ndarray:
        """Shared term count per (row, query)."""
        if not len(self.values):
            return np.zeros((len(lists), self.weights.shape[1]), dtype=np.float32)
        return self.occurrences(lists) @ self.weights

    @property
    def width(self) -> int:
        return max(1, len(self.values))


class PhraseMatrix:
    """Query phrases that rows hold anywhere in a text. Only rows with all grams inside a phrase are searched for it."""

    def __init__(self, term_lists):
        self.terms = TermMatrix(term_lists)
        self.phrases = self.terms.values.to_pylist()
        self.inner = TermMatrix([sorted({gram_code(g) for g in _INNER.findall(p)}) for p in self.phrases], pa.int64())
        self.needed = self.terms.needed

    def overlap(self, texts: pa.StringArray, grams: pa.ListArray | None) -> np.ndarray:
        found = np.zeros((len(texts), len(self.phrases)), dtype=np.float32)
        if not self.phrases:
            return np.zeros((len(texts), self.terms.weights.shape[1]), dtype=np.float32)
        near = self.inner.overlap(grams) if grams is not None else None
        for p, phrase in enumerate(self.phrases):
            rows = None if near is None or not self.inner.needed[p] else np.flatnonzero(near[:, p] >= self.inner.needed[p])
            if rows is None:
                found[:, p] = pc.fill_null(pc.match_substring(texts, phrase), False).to_numpy(zero_copy_only=False)
            elif len(rows):
                found[rows, p] = pc.fill_null(pc.match_substring(texts.take(pa.array(rows)), phrase), False).to_numpy(zero_copy_only=False)
        return found @ self.terms.weights


def is_word(term: str) -> bool:
    return 0 < len(term) <= 8 and term.isascii() and term.isalnum() and term == term.lower()


_WORD_BYTES = np.array([b if chr(b).isalnum() or b == 95 else 32 for b in range(128)] + [32] * 128, np.uint8)


def ascii_words(texts: pa.StringArray) -> pa.ListArray:
    """Runs of ASCII letters, digits and underscores of each text, with empty strings where other characters stand at its ends."""
    texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    plain = _WORD_BYTES[np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]]
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))


class Rows:
    """The columns of a batch by name, with grams unpacked and the words of ``norm`` split when first asked for."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self._words, self._grams = batch, None, None

    def __getitem__(self, name: str):
        at = self.batch.schema.get_field_index(name)
        return self.batch.column(at) if at >= 0 else None

    @property
    def grams(self) -> pa.ListArray | None:
        if self._grams is None and self["grams"] is not None:
            self._grams = gram_lists(self["grams"])
        return self._grams

    @property
    def words(self) -> pa.ListArray:
        if self._words is None:
            self._words = ascii_words(self["norm"])
        return self._words

    def __len__(self) -> int:
        return self.batch.num_rows


class TextTerms:
    """Words and phrases of one text channel."""

    def __init__(self, term_lists):
        self.words = TermMatrix([[t for t in terms if is_word(t)] for terms in term_lists])
        self.phrases = PhraseMatrix([[t for t in terms if not is_word(t)] for terms in term_lists])
        self.needed = self.words.needed + self.phrases.needed

    def overlap(self, rows: Rows) -> np.ndarray:
        out = self.phrases.overlap(rows["norm"], rows.grams)
        return out + self.words.overlap(rows.words) if self.words.needed.any() else out


class QueryFilters:
    """Per-query filters: any requested source, any requested place, all must-have terms."""

    def __init__(self, queries):
        self.sources = TermMatrix([q["want_sources"] for q in queries])
        self.places = PhraseMatrix([q["want_places"] for q in queries])
        self.must = TextTerms([[*q["must_words"], *q["must_phrases"]] for q in queries])

    def mask(self, rows: Rows) -> np.ndarray:
        keep = np.ones((len(rows), len(self.sources.needed)), dtype=bool)
        if self.sources.needed.any():
            keep &= (self.sources.needed == 0) | (self.sources.overlap(rows["sources"]) > 0)
        if self.places.needed.any():
            keep &= (self.places.needed == 0) | (self.places.overlap(rows["place_text"], None) > 0)
        if self.must.needed.any():
            keep &= self.must.overlap(rows) >= self.must.needed
        return keep


class Best:
    """The k best rows per query seen in a group, with their extra columns."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n_queries)]

    def add(self, ids: list, score: np.ndarray, extras: list[np.ndarray]) -> None:
        """``score`` is -inf where a row is no candidate of a query. Ties go to the smaller id."""
        live = np.flatnonzero((score > -np.inf).any(axis=0))
        for q in live:
            column = score[:, q]
            picked = np.flatnonzero(column > -np.inf)
            if len(picked) > self.k:
                floor = np.partition(column[picked], len(picked) - self.k)[len(picked) - self.k]
                picked = picked[column[picked] >= floor]
            kept = self.rows[q] + [(-column[i], ids[i], *[e[i, q] for e in extras]) for i in picked]
            kept.sort(key=lambda r: (r[0], r[1]))
            self.rows[q] = kept[:self.k]


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def meet_top_k(rows: DataFrame, queries: DataFrame, pairs: DataFrame, make_scorer: Callable, k: int, extra: dict[str, str]) -> DataFrame:
    """(query_id, person_id, rank_score, extras, rank): best ``k`` rows per query over the blocks it is paired with.

    rows: (person_id, block, ...); queries: (query_id, tile, ...); pairs: (query_id, block), distinct. ``make_scorer(queries)`` gets the
    queries of a group and returns ``(width, fn)``; ``fn(Rows) -> (scores, extras)``.
    """
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "person_id": rows.schema["person_id"].dataType.simpleString(), "rank_score": "double", **extra}
    arrow = pa.schema([(n, _ARROW[t]) for n, t in kinds.items()])

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        asked = right.to_pylist()
        width, score_block = make_scorer(asked)
        step = max(16, min(CELLS // len(asked), TERM_CELLS // width))
        best = Best(len(asked), k)
        for batch in left.combine_chunks().to_batches(max_chunksize=step):
            part = Rows(batch)
            score, extras = score_block(part)
            best.add(part["person_id"].to_pylist(), score, extras)
        flat = [(q["query_id"], r[1], -r[0], *r[2:]) for q, found in zip(asked, best.rows) for r in found]
        columns = list(zip(*flat)) if flat else [()] * len(arrow)
        cast = {"double": float, "int": int}
        return pa.table([pa.array([cast.get(t, lambda v: v)(v) for v in c], f.type) for c, f, t in zip(columns, arrow, kinds.values())], schema=arrow)

    wanted = queries.join(pairs, "query_id")
    # Stored, because then its size is known to be small before the rows would be shuffled for the join.
    groups = stored(wanted.select(F.col("block").alias("block"), F.col("tile").alias("tile")).distinct(), "groups")
    left = rows.join(groups, "block")
    met = left.groupBy("block", "tile").cogroup(wanted.groupBy("block", "tile")).applyInArrow(meet, ", ".join(f"{n} {t}" for n, t in kinds.items()))
    return top_k(met, ["query_id"], [F.desc("rank_score"), "person_id"], k)
