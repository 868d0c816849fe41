"""Token ids in binary files: one zstandard frame per document under a shared dictionary, with an index for direct access.

File: magic, id width (1 byte), SHA-256 of the dictionary, frames, index, footer. The index holds per document a null
flag, the id, the number of token ids and the end of its frame. The footer holds the index's place, the number of
documents and the magic again. Files follow each other in ascending doc_id order; the manifest lists them.

Documents are cut at the tokenizer's added tokens, which the library looks for in the raw text before anything else, and then at ASCII white
space, which the tokenizer drops and no token, and no normalisation, spans. Each distinct
chunk is encoded by the library once per worker and kept in a bounded table. A word of Latin-1 letters and the ASCII marks after it are two matches
of the tokenizer's splitting pattern: such pieces go to its model directly, shared among chunks, for many texts in one call.
"""
from __future__ import annotations

import hashlib
import math
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
import pyarrow as pa
import pyarrow.compute as pc

from .common import shared_folder, stored, utf8, with_results
from .sharing import reading, writing

MAGIC = b"TOKIDS01"
END_ID = 2
MEMO_ENTRIES = 650_000
PIECE_BYTES = 4 << 20
GROUP_BYTES = 2 << 20        # text bytes whose chunks are looked up and encoded together
WORD_AND_MARKS = re.compile("([a-zªµºß-öø-ÿ]*)([!-/:-@[-`{-~]*)").fullmatch
PART_BYTES = 24 << 20        # text bytes that go to one file
DICTIONARY_BYTES = 64 << 10
# Whole documents that train the dictionary: about so many of so many bytes in all, none longer than the last. No results depend on them.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LONGEST = 1500, 8 << 20, 1 << 20


class ChunkTokenizer:
    """Encodes texts with a tokenizer that drops white space."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # they are cut out before; what reads like one in lower case only is ordinary text
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added_pattern = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.added = {t: array(self.kind, [i]).tobytes() for t, i in added.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # The same model for pieces that need no normalising and no splitting, their bytes written as the tokenizer writes them.
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = "".join(chr(b if b in shown else next(hidden)) for b in range(256)).replace(chr(256 + 32), " ")
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, missing: list[bytes]) -> None:
        if len(self.memo) > MEMO_ENTRIES:
            self.old, self.memo = self.memo, {b"": b""}
        memo, old, new, whole, split = self.memo, self.old, [], [], []
        pieces: dict[bytes, None] = {}
        for chunk in missing:
            known = old.get(chunk)
            if known is None:
                new.append(chunk)
            else:
                memo[chunk] = known
        texts = b" ".join(new).decode("utf-8", "replace")
        for chunk, text in zip(new, texts.lower().split(" "), strict=True) if new else ():
            match = WORD_AND_MARKS(text)
            if match is None:
                whole.append(chunk)
                continue
            word, marks = (p.encode() for p in match.groups())
            if chunk == word or chunk == marks:
                pieces[chunk] = None
                continue
            split.append((chunk, word, marks))
            for piece in (word, marks):
                if piece not in memo:
                    known = old.get(piece)
                    if known is None:
                        pieces[piece] = None
                    else:
                        memo[piece] = known
        if pieces:
            # Each of these is one match of the splitting pattern, and only its last token ends a word.
            text = b" ".join(pieces).decode("latin-1").translate(self.letters)
            ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            packed, at = ids.tobytes(), 0
            for piece, end in zip(pieces, ends.tolist(), strict=True):
                memo[piece] = packed[at:end]
                at = end
        for chunk, encoding in zip(whole, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in whole], add_special_tokens=False) if whole else ()):
            memo[chunk] = array(self.kind, encoding.ids).tobytes()
        for chunk, word, marks in split:
            memo[chunk] = memo[word] + memo[marks]

    def _parts(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of texts without added tokens. Each distinct chunk is looked up once, and what is new is learnt in one call."""
        if not raws:
            return []
        lists = pc.ascii_split_whitespace(pa.array([raw.lower() if _in_latin_1(raw) else raw for raw in raws], pa.large_binary()).view(pa.large_string()))
        chunks = lists.flatten().view(pa.large_binary()).dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks.dictionary)], chunks.dictionary), pa.scalar(b" ", pa.large_binary()))[0].as_py().split(b" ")
        ids = list(map(self.memo.get, distinct))
        holes = [i for i, known in enumerate(ids) if known is None]
        if holes:
            self._learn([distinct[i] for i in holes])
            for i in holes:
                ids[i] = self.memo[distinct[i]]
        packed = pa.array(ids, pa.large_binary()).take(chunks.indices)
        _, ends, data = packed.buffers()
        at = np.frombuffer(ends, np.int64, len(packed) + 1)[lists.offsets.to_numpy()].tolist()
        data = data.to_pybytes() if data else b""
        return [data[begin:end] for begin, end in zip(at, at[1:])]

    def encode(self, raw: bytes) -> bytes:
        """Packed ids."""
        if not self._holds_added(raw):
            return self._text(raw)
        return b"".join(self.added.get(piece) or self._text(piece) for piece in self.added_pattern.split(raw))

    def encode_all(self, raws: Iterable[bytes]) -> Iterator[bytes]:
        """Packed ids of each text in turn, about GROUP_BYTES of texts at a time."""
        group, held = [], 0
        for raw in raws:
            alone = len(raw) > GROUP_BYTES or self._holds_added(raw)
            if not alone:
                group.append(raw)
                held += len(raw)
            if alone or held > GROUP_BYTES:
                yield from self._parts(group)
                group, held = [], 0
            if alone:
                yield self.encode(raw)
        yield from self._parts(group)

    def _holds_added(self, raw: bytes) -> bool:
        return any(t in raw for t in self.added)

    def _text(self, raw: bytes) -> bytes:
        """Packed ids of a text without added tokens, about four megabytes at a time."""
        if len(raw) <= PIECE_BYTES:
            return self._parts([raw])[0]
        parts, at = [], 0
        while at < len(raw):
            cut = raw.find(b" ", at + PIECE_BYTES)
            cut = len(raw) if cut < 0 else cut
            parts += self._parts([raw[at:cut]])
            at = cut
        return b"".join(parts)


def _in_latin_1(raw: bytes) -> bool:
    """Whether no combining mark can follow a letter, so that ASCII letters may be put in lower case before all else."""
    if raw.isascii():
        return True
    try:
        raw.decode().encode("latin-1")
    except UnicodeError:
        return False
    return True


@lru_cache(1)
def worker_tokenizer(tokenizer_path: str) -> ChunkTokenizer:
    """One tokenizer for all tasks of a worker process, with what it has learnt."""
    return ChunkTokenizer(tokenizer_path)


def encode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", end_id: int = END_ID, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the packed little-endian ids of each text and the end id. Null texts are empty."""
    def start():
        codec = worker_tokenizer(tokenizer_path)
        end = array(codec.kind, [end_id]).tobytes()
        return lambda columns: [[ids + end for ids in codec.encode_all(columns["text"])]]

    return with_results(docs, {"text": utf8(text_col)}, start, {"ids": "binary"}, keep)


def train_dictionary(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> bytes:
    """Dictionary trained on the serialized ids of about SAMPLE_DOCS whole documents; empty without enough data.

    A hash of id and text below a share of its range picks them, so that no task or shuffle sees more than the sample.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    rows = docs.filter(size <= SAMPLE_LONGEST)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    share = min(1.0, SAMPLE_DOCS / max(n, 1), SAMPLE_BYTES / max(total, 1))
    h = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40))
    sample = rows.filter(h < F.lit(int(share * (1 << 40)) + 1)).select(F.col(text_col).alias("text"), h.alias("h")).orderBy("h").limit(2 * SAMPLE_DOCS)
    arrays = [bytes(r[0]) for r in encode(sample.select("text"), tokenizer_path, end_id=end_id, keep=[]).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


class TokenFile:
    """Reads one file: ``documents()`` streams it, ``document(i)`` seeks to one."""

    def __init__(self, uri: str, dictionary: bytes):
        self.file = reading(uri)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[:len(MAGIC)] != MAGIC or head[-32:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} is no token file of this dictionary")
        self.width, self.first = head[len(MAGIC)], len(head)
        at, count = struct.unpack("<QQ", self.file.read_at(16, self.file.size() - 16 - len(MAGIC)))
        index = self.file.read_at(count * 25, at)
        self.null = np.frombuffer(index, np.uint8, count)
        self.doc_id, self.tokens, self.end = (np.frombuffer(index, "<i8", count, count + i * 8 * count) for i in range(3))
        self.unpack = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.null)

    def document(self, i: int) -> np.ndarray:
        begin = int(self.end[i - 1]) if i else self.first
        raw = self.unpack.decompress(self.file.read_at(int(self.end[i]) - begin, begin), max_output_size=int(self.tokens[i]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def documents(self):
        for i in range(len(self)):
            yield (None if self.null[i] else int(self.doc_id[i])), self.document(i)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, part_bytes: int = PART_BYTES) -> tuple[DataFrame, bytes]:
    """Encode all documents into files of ascending id; returns (manifest of part, uri, docs, tokens; dictionary).

    Rows with a null id come first; equal ids are ordered by a hash of their text. Null texts are empty, and hold just the end id.
    No documents give no files. The text is shuffled once by range; the ids are written where they are made.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id)
    with writing(f"{folder}/dictionary.zstd") as f:
        f.write(dictionary)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / part_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("id"), "h").sortWithinPartitions(F.asc_nulls_first("id"), "h").select("id", "text")

    def run(batches):
        codec, stamp, part = worker_tokenizer(tokenizer_path), hashlib.sha256(dictionary).digest(), TaskContext.get().partitionId()
        end, pack = array(codec.kind, [end_id]).tobytes(), zstandard.ZstdCompressor(level=3, **_dictionary(dictionary))
        uri, null, ids, tokens, ends, at = f"{folder}/part-{part:06d}.ids", bytearray(), array("q"), array("q"), array("q"), 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return

        def texts():
            for batch in chain([first], batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    null.append(doc_id is None)
                    ids.append(doc_id or 0)
                    yield text.as_py()

        with writing(uri) as f:
            head = MAGIC + bytes([codec.width]) + stamp
            f.write(head)
            at = len(head)
            for packed in codec.encode_all(texts()):
                packed += end
                frame = pack.compress(packed)
                f.write(frame)
                at += len(frame)
                tokens.append(len(packed) // codec.width)
                ends.append(at)
            f.write(bytes(null) + ids.tobytes() + tokens.tobytes() + ends.tobytes() + struct.pack("<QQ", at, len(null)) + MAGIC)
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "docs": [len(null)], "tokens": [sum(tokens)]})

    return stored(rows.mapInArrow(run, "part long, uri string, docs long, tokens long"), "manifest"), dictionary


def read_token_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every document in the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("part", "uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows, held = [], 0
                for doc_id, ids in TokenFile(uri, dictionary).documents():
                    rows.append((doc_id, base, len(ids), ids.tobytes()))
                    base, held = base + len(ids), held + ids.nbytes
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return placed.repartition(files, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])
