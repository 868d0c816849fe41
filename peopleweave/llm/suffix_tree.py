"""Language-model scores by a probabilistic suffix tree over words.

Every word of every training document is counted. Contexts of one to ``DEPTH`` words, and the words that follow them, enter the
tree when they occur at least ``LEAST`` times in the training documents, whatever the size of the corpus, so that the tree grows with it. They are
found level by level: a longer sequence can only occur that often if both its ends do. A context is retained if its
next-word distribution diverges from that of its longest retained suffix by more than its description costs.
Distributions are smoothed by handing the mass of all other words down to the suffix, and in the end to the
add-one distribution of single words. A token is scored in the states of all retained suffixes, the longest deciding.

The tree is never in one place. Documents are encoded in chunks of about ``CHUNK`` tokens. A chunk asks for its distinct sequences, once
each and sorted by hash, at the buckets that their hashes fall into; a bucket adds up what all chunks sent and answers in the order of
the question. So a sequence costs one entry per chunk, however often it occurs. Chunks and the answers they have got lie in files of the shared
folder; a step shuffles new questions and new answers only. Words and sequences are told apart by
64-bit hashes. ``SuffixTree`` is the same model in memory.
"""
from __future__ import annotations

import pickle
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from .common import shared_folder, stored, utf8
from .sharing import reading, writing

DEPTH = 3
LEAST = 2                # occurrences of a sequence in the tree; one occurrence tells nothing about a distribution
CHUNK = 1 << 20          # tokens after which a chunk of documents is closed
BUCKET, BUCKETS = 1 << 21, 64    # tokens per bucket, and buckets at least
ALPHA = 1.0              # smoothing mass of a context besides its count
FLUSH = 400_000          # distinct sequences a task of sequence_counts holds before it passes its counts on
END = b""


def tokens_of(raw: bytes) -> list[bytes]:
    """Words of the text with A-Z in lower case, cut at ASCII white space, and one end."""
    words = raw.lower().split()
    words.append(END)
    return words


def lookup(kept: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Index of each code in the sorted array of kept codes, or -1; codes below 0 are none."""
    if not len(kept):
        return np.full(len(codes), -1, np.int64)
    at = np.minimum(np.searchsorted(kept, codes), len(kept) - 1)
    return np.where((codes >= 0) & (kept[at] == codes), at, -1)


def extend(ids: np.ndarray, kept: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each level the index of the kept sequence of that length that ends at each place, or -1."""
    levels = [ids]
    for codes in kept:
        last = levels[-1]
        joined = np.full(len(ids), -1, np.int64)
        if len(ids) > 1:
            joined[1:] = np.where((last[:-1] >= 0) & (last[1:] >= 0), last[:-1] * width + ids[1:], -1)
        levels.append(lookup(codes, joined))
    return levels


def _stream(binaries) -> np.ndarray:
    """Word indices of a batch of documents in one array, with a -1 after each document."""
    gap = np.array([-1], np.int32).tobytes()
    return np.frombuffer(b"".join([x for b in binaries for x in (b, gap)]), np.int32).astype(np.int64)


def sequence_counts(encoded: DataFrame, kept: list[np.ndarray], width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and counts of the sequences one longer than the last kept ones that occur at least ``least`` times."""
    def count(batches):
        held, size = [], 0

        def merged():
            codes = np.concatenate([c for c, _ in held])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], np.concatenate([n for _, n in held])[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            return codes[first], np.add.reduceat(counts, first)

        def batch_of(codes, counts):
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _stream(batch.column(0).to_pylist())
            last = extend(ids, kept, width)[-1]
            both = (last[:-1] >= 0) & (last[1:] >= 0)
            codes, counts = np.unique(last[:-1][both] * width + ids[1:][both], return_counts=True)
            if len(codes):
                held.append((codes, counts))
                size += len(codes)
            if size > FLUSH * 4:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH * 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*merged())

    rows = encoded.filter("learn").select("ids").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = sorted((r["code"], r["n"]) for r in rows.collect())
    return np.array([c for c, _ in found], np.int64), np.array([n for _, n in found], np.float64)


class SuffixTree:
    """Retained contexts of a few words with their next words; ``single`` are the probabilities of frequent words."""

    def __init__(self, single: np.ndarray, counts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], alpha: float = ALPHA):
        self.width = len(single)
        self.single, self.codes = single, [c for c, _ in levels]
        self.next: list[np.ndarray] = []     # per level: probability that a kept sequence's last word gets from its context
        self.rest: list[np.ndarray] = []     # per level: mass that a context hands to its suffix; 1 where it is not retained
        context_counts = counts.astype(np.float64)
        self.retained: list[np.ndarray] = []
        # lower[i]: probability of the last word of kept sequence i given the context without its first word.
        for level, (codes, n) in enumerate(levels):
            context, word = codes // self.width, codes % self.width
            lower = self._lower(level, context, word)
            total = np.maximum(context_counts, 1.0)
            size = len(total)
            share = n / total[context] if len(codes) else n
            kinds, kept = np.bincount(context, minlength=size), np.bincount(context, n, size)
            gain = np.bincount(context, n * np.log(np.maximum(share, 1e-300) / lower), size)
            left, left_lower = np.maximum(total - kept, 0), np.maximum(1 - np.bincount(context, lower, size), 1e-12)
            gain = gain + np.where(left > 0, left * np.log(np.maximum(left / total, 1e-300) / left_lower), 0)
            retained = (kinds > 0) & (gain > 0.5 * (1 + kinds) * np.log(total + 1))
            self.retained.append(retained)
            self.rest.append(np.where(retained, 1 - kept / (total + alpha), 1.0))
            self.next.append(np.where(retained[context], n / (total[context] + alpha), 0.0) if len(codes) else n)
            context_counts = n

    def _lower(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of each word in the context without its first word."""
        p = self.single[word].copy() if len(word) else np.zeros(0)
        if level == 0:
            return p
        # The words of the context, first to last.
        words, c = [], context
        for k in range(level - 1, -1, -1):
            words.append(self.codes[k][c] % self.width)
            c = self.codes[k][c] // self.width
        words = [c, *reversed(words)]
        for k in range(level):     # suffixes of k + 1 words
            state = words[level - k].copy()
            for j in range(k):
                state = lookup(self.codes[j], np.where(state >= 0, state * self.width + words[level - k + 1 + j], -1))
            ok = state >= 0
            follow = lookup(self.codes[k], np.where(ok, state * self.width + word, -1))
            own = np.where(follow >= 0, self.next[k][follow] if len(self.next[k]) else 0.0, 0.0)
            p = np.where(ok, own + np.where(ok, self.rest[k][state], 1.0) * p, p)
        return np.maximum(p, 1e-300)

    def logs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, log10 probability as a single word) at each place; for a word that is not among the
        frequent ones both leave out the probability of the word itself, which is a factor."""
        rare = ids < 0
        base = np.where(rare, 1.0, self.single[np.maximum(ids, 0)])
        p, levels = base.copy(), extend(ids, self.codes, self.width)
        for k, rest in enumerate(self.rest):
            state = np.r_[-1, levels[k][:-1]]
            follow = levels[k + 1]
            own = np.where(follow >= 0, self.next[k][np.maximum(follow, 0)], 0.0) if len(self.next[k]) else 0.0
            p = np.where(state >= 0, own + rest[np.maximum(state, 0)] * p, p)
        return np.log10(p), np.log10(base)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; whole numbers take no more bytes than the largest needs."""
    if values.dtype.kind in "iu" and len(values):
        values = values.astype(np.min_scalar_type(int(values.max())), copy=False)
    raw = np.ascontiguousarray(values).view(np.uint8)
    raw = raw.reshape(-1, values.itemsize).T.tobytes() if values.itemsize > 1 else raw.tobytes()
    return len(values).to_bytes(8, "little") + bytes([values.itemsize]) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(raw: bytes, kind) -> np.ndarray:
    """The numbers of ``pack`` (whole ones are 0 or more) as ``kind``."""
    n, width, kind = int.from_bytes(raw[:8], "little"), raw[8], np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    if width > 1:
        planes = np.ascontiguousarray(planes.reshape(width, n).T).view(f"{'f' if kind.kind == 'f' else 'u'}{width}").ravel()
    return planes.astype(kind, copy=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order of appearance, place of the first of each, number of its value for each place), without a sort."""
    inverse, every = pd.factorize(values)
    at = np.empty(len(every), np.int64)
    at[inverse[::-1]] = np.arange(len(values) - 1, -1, -1)
    return every, at, inverse


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted hashes are cut into buckets of equal ranges."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


ASKED = "kind long, level long, bucket long, chunk long, hashes binary, n binary, a binary, b binary, c binary, d binary"
ANSWERED = "kind long, level long, bucket long, chunk long, values binary, first binary, tokens long, kinds long"
COUNT, SUM = 0, 1


class Chunk:
    """A chunk of encoded documents with the levels of its sequences, as far as the answers go.

    ``facts`` are the values of earlier answers by sequence, in the order in which sequences appear in the chunk, and for longer ones
    the places of those that are kept, so that the others are not laid out again; ``answers`` are new ones, in the order of their hashes, which become the facts in ``new``.
    """

    def __init__(self, number: int, row: dict, facts: dict, answers: list[dict], least: tuple[float, float], alpha: float, n_train: int, kinds: int):
        self.number, self.least, self.alpha = number, least, alpha
        self.sizes, learn = unpack(row["sizes"], np.int64), unpack(row["learn"], np.int8)
        flat, self.words = unpack(row["ids"], np.int32).astype(np.int64), unpack(row["words"], np.uint64)
        self.real = np.ones(len(flat) + len(self.sizes), bool)
        self.real[np.cumsum(self.sizes + 1) - 1] = False
        self.ids = np.full(len(self.real), -1, np.int64)
        self.ids[self.real] = flat
        self.learn = np.repeat(learn, self.sizes + 1).astype(np.float64)
        self.answers: dict = {}
        for r in sorted(answers, key=lambda r: r["bucket"]):
            self.answers.setdefault((r["kind"], r["level"]), []).append((r["values"], r["first"]))
        self.facts, self.new = facts, {}
        # Per level: index of the sequence that ends at each place or -1; hash, places and their sequences, sequence without its last and without its first word.
        self.levels = [(self.ids, self.words, (self.real, flat), None, None)]
        self.orders: dict[int, np.ndarray] = {}
        self.n, self.kept, self.first = [], [], []
        self.rest: list[np.ndarray] = []
        self.single, self.p = None, []
        while self._has(COUNT, len(self.levels)):
            self._next()
        if self.n:
            self.single = (self.n[0] + 1) / (n_train + kinds + 1)
            self.p = [self.single]
        while self._has(SUM, len(self.rest) + 1):
            self._decided()

    def _has(self, kind: int, level: int) -> bool:
        return (kind, level) in self.facts or (kind, level) in self.answers

    def _order(self, k: int) -> np.ndarray:
        """Sequences of k + 1 words by hash, as a question lists them."""
        if k not in self.orders:
            self.orders[k] = np.argsort(self.levels[k][1])
        return self.orders[k]

    def _values(self, kind: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(value, is this chunk the first to hold it) of each sequence of ``level`` words."""
        if (kind, level) in self.facts:
            return tuple(unpack(x, np.int64) for x in self.facts[kind, level][:2])
        order = self._order(level - 1)
        if kind == SUM:
            order = order[self.kept[level - 1][order]]
        out = []
        for which in (0, 1):
            values = np.zeros(len(self.levels[level - 1][1]), np.int64)
            values[order] = np.concatenate([unpack(x[which], np.int64) for x in self.answers[kind, level]])
            out.append(values)
        if kind == COUNT and level > 1:
            kept = out[0] >= self.least[1]
            self.new[kind, level] = [*[pack(x[kept]) for x in out], pack(np.packbits(np.append(kept, False)[self.levels[-1][0]]))]
        else:
            self.new[kind, level] = [pack(x) for x in out]
        return tuple(out)

    def _next(self) -> None:
        """Take the counts of the last level and lay out the sequences one longer, of which both ends are kept."""
        level = len(self.levels)
        n, first = self._values(COUNT, level)
        self.n.append(n.astype(np.float64))
        self.first.append(first > 0)
        kept = n >= self.least[level > 1]
        self.kept.append(kept)
        index, hashes = self.levels[-1][:2]
        known = self.facts.get((COUNT, level + 1))
        if known:
            places = np.flatnonzero(np.unpackbits(unpack(known[2], np.uint8), count=len(index)))
        else:
            have = np.append(kept, False)[index]      # places without a sequence are -1
            places = np.flatnonzero(have[:-1] & have[1:]) + 1
        codes, at, inverse = _distinct(index[places - 1] * len(self.words) + self.ids[places])
        longer = np.full(len(index), -1, np.int64)
        longer[places] = inverse
        before, word = codes // len(self.words), codes % len(self.words)
        own = mixed(hashes[before] ^ mixed(self.words[word] + np.uint64(level)))
        self.levels.append((longer, own, (places, inverse), before, index[places[at]]))

    def _decided(self) -> None:
        """Take the masses that the contexts of the next length hand down."""
        k = len(self.rest)
        rest = 1 - self._values(SUM, k + 1)[0] / (self.n[k] + self.alpha)
        self.rest.append(rest)
        _, _, _, before, after = self.levels[k + 1]
        own = np.where(rest[before] < 1, self.n[k + 1] / (self.n[k][before] + self.alpha), 0.0)
        self.p.append(own + rest[before] * self.p[k][after])

    def _rows(self, kind: int, level: int, hashes: np.ndarray, values: list[np.ndarray], buckets: int) -> list[dict]:
        cuts = _cuts(hashes, buckets)
        return [dict(zip(("kind", "level", "bucket", "chunk", "hashes", "n", "a", "b", "c", "d"), (kind, level, b, self.number, pack(np.diff(hashes[i:j], prepend=np.uint64(0))), *[pack(v[i:j]) for v in values], *[None] * (5 - len(values)))))
                for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]

    def ask_counts(self, buckets: int) -> list[dict]:
        order, (_, hashes, (places, inverse), _, _) = self._order(len(self.levels) - 1), self.levels[-1]
        counts = np.bincount(inverse, self.learn[places], len(hashes)).astype(np.int64)
        return self._rows(COUNT, len(self.levels), hashes[order], [counts[order]], buckets)

    def ask_sums(self, buckets: int) -> list[dict]:
        """What the sequences that this chunk answers for add to their contexts. The count of a context comes from the first chunk that holds it.

        Gains and lower probabilities travel in single precision: they only decide whether a context is retained.
        """
        k = len(self.rest)
        _, _, _, before, after = self.levels[k + 1]
        mine = self.first[k + 1] & self.kept[k + 1]
        context, n, lower = before[mine], self.n[k + 1][mine], np.maximum(self.p[k][after[mine]], 1e-300)
        size, order = len(self.n[k]), self._order(k)
        order = order[self.kept[k][order]]
        gain = np.bincount(context, n * np.log(n / self.n[k][context] / lower), size)
        followers, kept, below = np.bincount(context, minlength=size), np.bincount(context, n, size).astype(np.int64), np.bincount(context, lower, size)
        own = np.where(self.first[k], self.n[k], 0).astype(np.int64)
        return self._rows(SUM, k + 1, self.levels[k][1][order], [v[order] for v in (own, followers, kept, gain.astype(np.float32), below.astype(np.float32))], buckets)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known words, log10 probability as single words, log10 probability) of each document."""
        known, base = np.zeros(len(self.ids)), np.ones(len(self.ids))
        real = self.real
        known[real], base[real] = self.n[0][self.ids[real]] > 0, self.single[self.ids[real]]
        p = base.copy()
        for k, rest in enumerate(self.rest):
            state, follow, before = np.r_[-1, self.levels[k][0][:-1]], self.levels[k + 1][0], self.levels[k + 1][3]
            own = np.where(rest[before] < 1, self.n[k + 1] / (self.n[k][before] + self.alpha), 0.0)
            # Places without a sequence are -1: they get nothing and hand all down.
            p = np.append(own, 0.0)[follow] + np.append(rest, 1.0)[state] * p
        p[~real] = 1.0
        begins = np.r_[0, np.cumsum(self.sizes + 1)[:-1]].astype(np.int64)
        return tuple(np.add.reduceat(v, begins) for v in (known, np.log10(base), np.log10(p)))


def answered(asked: pa.Table, least: float, alpha: float) -> pa.Table:
    """What a bucket answers to the chunks: counts (0 below the least), or how often each context is followed by kept words (0 where it is not retained)."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["chunk"])
    kind, level, bucket = (rows[0][k] for k in ("kind", "level", "bucket"))
    hashes = [np.cumsum(unpack(r["hashes"], np.uint64), dtype=np.uint64) for r in rows]
    cuts = np.r_[0, np.cumsum([len(h) for h in hashes])]
    every, at, inverse = _distinct(np.concatenate(hashes))
    first, tokens, kinds = np.zeros(cuts[-1], np.int8), 0, 0

    def total(name: str, dtype) -> np.ndarray:
        return np.bincount(inverse, np.concatenate([unpack(r[name], dtype) for r in rows]), len(every))

    if kind == COUNT:
        n = total("n", np.int64).astype(np.int64)
        tokens, kinds = int(n.sum()), int((n > 0).sum())
        values = np.where(n >= (1 if level == 1 else least), n, 0)
        first[at] = values > 0
    else:
        n, followers, kept, gain, lower = total("n", np.int64), total("a", np.int64), total("b", np.int64), total("c", np.float64), total("d", np.float64)
        left, left_lower = np.maximum(n - kept, 0), np.maximum(1 - lower, 1e-12)
        gain = gain + np.where(left > 0, left * np.log(np.maximum(left / n, 1e-300) / left_lower), 0)
        retained = (followers > 0) & (gain > 0.5 * (1 + followers) * np.log(n + 1))
        values = np.where(retained, kept, 0).astype(np.int64)
    values = values[inverse]
    out = [{"kind": kind, "level": level, "bucket": bucket, "chunk": r["chunk"], "values": pack(values[i:j]), "first": pack(first[i:j]), "tokens": tokens if not c else 0, "kinds": kinds if not c else 0}
           for c, (r, i, j) in enumerate(zip(rows, cuts[:-1], cuts[1:]))]
    return pa.Table.from_pylist(out, pa.schema([(k, pa.binary() if k in ("values", "first") else pa.int64()) for k in out[0]]))


class ChunkFiles:
    """Files of the encoded chunks and of what the answers so far say, in the shared folder: neither is shuffled again for a later level.

    A task that is repeated writes the same file once more, and files appear under their names only when complete.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, chunk: int, name: str, value) -> None:
        with writing(f"{self.folder}/{chunk}.{name}") as f:
            f.write(pickle.dumps(value, protocol=5))

    def read(self, chunk: int, name: str):
        with reading(f"{self.folder}/{chunk}.{name}") as f:
            return pickle.loads(f.read())

    def load(self, chunk: int, step: int, new: list[dict], model: tuple, last: bool = False) -> Chunk:
        """The chunk before it asks in ``step``; ``new`` are the answers to its questions of the step before. Unless it is the last step, what they say is kept for later ones."""
        facts: dict = {}
        for s in range(1, step - 1):
            facts.update(self.read(chunk, f"facts{s}"))
        loaded = Chunk(chunk, self.read(chunk, "documents"), facts, new, *model)
        if step > 1 and not last:
            self.write(chunk, f"facts{step - 1}", loaded.new)
        return loaded


def chunks_of(docs: DataFrame, text: Column, train: Column, kept: list[str], files: ChunkFiles) -> DataFrame:
    """(chunk, tokens, kept columns as arrays) of documents in chunks; the words, as numbers within the chunk, go to its file."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], text.alias("__text"), F.coalesce(train, F.lit(False)).alias("__learn"))
    width, limit = len(kept), CHUNK

    def encode(batches):
        number = TaskContext.get().partitionId() << 33

        def closed():
            words = np.fromiter(map(xxh3_64_intdigest, index), np.uint64, len(index))
            packed = {"ids": pack(np.concatenate(ids)), "words": pack(words), "sizes": pack(np.array(sizes, np.int64)), "learn": pack(np.array(learn, np.int8))}
            files.write(number, "documents", packed)
            lists = []
            for i in range(width):
                values = pa.concat_arrays([b.column(i) for b in held])
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays([*lists, pa.array([sum(sizes)], pa.int64()), pa.array([number], pa.int64())], names=[*[f"__k{i}" for i in range(width)], "tokens", "chunk"])

        def fresh():
            d = defaultdict()
            d.default_factory = d.__len__
            return d, [], [], [], []

        index, ids, sizes, learn, held = fresh()
        size = 0
        for batch in batches:
            begin = 0
            flags = batch.column(width + 1).to_pylist()
            for r, raw in enumerate(batch.column(width).to_pylist()):
                words = tokens_of(raw)
                ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                sizes.append(len(words))
                learn.append(flags[r])
                size += len(words)
                if size >= limit:
                    held.append(batch.slice(begin, r + 1 - begin))
                    begin = r + 1
                    yield closed()
                    number += 1
                    index, ids, sizes, learn, held = fresh()
                    size = 0
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if sizes:
            yield closed()

    schema = StructType([*[StructField(f"__k{i}", ArrayType(frame.schema[i].dataType)) for i in range(width)], StructField("tokens", LongType()), StructField("chunk", LongType())])
    return stored(frame.mapInArrow(encode, schema), "chunks")


@contextmanager
def shuffles_deleted(spark):
    """Spark deletes the shuffle files of a query as soon as it has ended: what it has written is all that later steps read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def _delete(spark, path: str) -> None:
    """Remove a table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def score(docs: DataFrame, train: Column, *, text_col: str = "text", depth: int = DEPTH, word_share: float = 0.0, gram_share: float = 0.0, least: int = LEAST,
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` (kept columns) with n_tokens, n_known, train_tokens, base_score and score (log10), the model learnt from the rows where ``train`` holds.

    Sequences of at least ``least`` occurrences enter the tree; a ``gram_share`` or ``word_share`` above 0 asks besides for that share of all training tokens, for
    sequences and for the words in them. Null texts are empty and consist of the end alone. Rows are scored one by one, so repeated rows repeat. Kept columns with a result's
    name are replaced. Without training rows all words are unknown and share one probability.
    """
    spark = docs.sparkSession
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    files = ChunkFiles(shared_folder(spark, "chunks"))
    chunks = chunks_of(docs, utf8(text_col), train, kept, files)
    tokens, count = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    buckets, tasks = max(BUCKETS, -(-tokens // BUCKET)), max(1, count)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    asked_schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.binary()) for c in ASKED.split(", ")])
    answers, path, n_train, kinds, floors = None, None, 0, 0, (float(least), float(least))

    def asker(step: int, model: tuple):
        def ask(new: pa.Table) -> pa.Table:
            rows = new.to_pylist()
            chunk = files.load(rows[0]["chunk"], step, rows if step > 1 else [], model)
            asked = chunk.ask_counts(buckets) if step <= depth + 1 else []
            return pa.Table.from_pylist(asked + (chunk.ask_sums(buckets) if step > 2 else []), asked_schema)
        return ask

    def bucket_of(sequences: float):
        return lambda rows: answered(rows, sequences, ALPHA)

    for step in range(1, depth + 3):
        ask, sequences = asker(step, (floors, ALPHA, n_train, kinds)), floors[1]
        # A chunk's questions need its file and the new answers only. The number of tasks is set, as a few small rows stand for much work.
        before = (chunks.select("chunk") if answers is None else answers).repartition(tasks, "chunk")
        asked = before.groupBy("chunk").applyInArrow(ask, ASKED)
        done, path = path, shared_folder(spark, "answers")
        with shuffles_deleted(spark):
            asked.groupBy("kind", "level", "bucket").applyInArrow(bucket_of(sequences), ANSWERED).write.parquet(path)
        answers = spark.read.schema(ANSWERED).parquet(path)
        if done:
            _delete(spark, done)     # every chunk has written these answers to its own file
        if step == 1:
            n_train, kinds = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
            floors = max(floors[0], word_share * n_train), max(floors[1], gram_share * n_train)

    model = floors, ALPHA, n_train, kinds

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = files.load(left.column("chunk")[0].as_py(), depth + 3, right.to_pylist(), model, last=True)
        known, base, full = chunk.sums()
        columns = [left.column(f"__k{i}").chunk(0)[0].values for i in range(len(kept))]
        numbers = [pa.array(chunk.sizes), pa.array(known.astype(np.int64)), pa.array(np.full(len(known), n_train, np.int64)), pa.array(base), pa.array(full)]
        return pa.Table.from_arrays([*columns, *numbers], names=[*kept, *results])

    out = StructType([*schema.fields, *[StructField(c, LongType()) for c in results[:3]], StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(finish, out)
