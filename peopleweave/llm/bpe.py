"""Byte-level BPE encoding and decoding as a monoid tree.

A match of the splitting pattern is encoded by halves: leaves of a few bytes are merged directly, and two encoded halves
are joined by re-encoding a window of tokens around the boundary. The window doubles until its outer tokens are
compatible with their outer neighbours. Two tokens are compatible if encoding their joined bytes gives just these
two again. A token sequence whose neighbours are all compatible is the encoding of its bytes: the first merge (by rank,
then position) that crossed a token border would cross it for these two tokens alone as well. So tokens outside
the window are final. Decoding concatenates halves up the same tree.

Distinct matches are encoded once per worker and kept in a bounded table, as a text's matches repeat.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_results

LEAF_BYTES = 6
MEMO_ENTRIES = 400_000
# White space as the patterns of tiktoken mean it. Fixed value.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(None)
def char_class(kind: str, last: int = sys.maxunicode) -> str:
    """Ranges, for use inside brackets, of the characters up to ``last`` whose general category starts with ``kind``."""
    ranges: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(None)
def compiled(pattern: str, last: int = sys.maxunicode) -> re.Pattern:
    """A pattern with ``\\p{L}``, ``\\p{N}`` and ``\\s`` in their Unicode meaning, for texts of characters up to ``last``."""
    out, inside, i = [], False, 0
    classes = {r"\p{L}": char_class("L", last), r"\p{N}": char_class("N", last), r"\s": SPACE}
    while i < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, i)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
        elif pattern.startswith(r"\S", i):
            out.append(f"[^{SPACE}]")
            i += 2
        else:
            step = 2 if pattern[i] == "\\" else 1
            inside = {"[": True, "]": False}.get(pattern[i], inside)
            out.append(pattern[i:i + step])
            i += step
    return re.compile("".join(out))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TreeCodec:
    """Encodes and decodes byte strings by ranks."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, leaf
        self.token = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.short: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short string by lowest rank first, leftmost first. The result is shared; don't change it."""
        found = self.short.get(data)
        if found is None:
            if len(data) > 16:
                return self._merge_long(data) if len(data) > 64 else self._merge_short(data)
            if len(self.short) >= MEMO_ENTRIES:
                self.short.clear()
            found = self.short[data] = self._merge_short(data)
        return found

    def _merge_short(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i:i + 1] for i in range(len(data))]
        near = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while near:
            low = min(near)
            if low == 1 << 30:
                break
            i = near.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for a long window, with a heap over a linked list."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))        # end of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if i and (r := ranks.get(data[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def pair(self, key: tuple[int, int]) -> list[int]:
        """The encoding of two tokens' joined bytes."""
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            found = self.pairs[key] = self._merge_short(self.token[key[0]] + self.token[key[1]])
        return found

    def compatible(self, a: int, b: int) -> bool:
        found = self.pair((a, b))
        return len(found) == 2 and found[0] == a

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two joined strings from their encodings."""
        window = self.pair((left[-1], right[0]))
        if len(window) == 2 and window[0] == left[-1]:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            if (a == 0 or self.compatible(left[a - 1], window[0])) and (b == len(right) or self.compatible(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2
            window = self.merge(self.decode(left[-k:] + right[:k]))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match. A match that is a token itself is that token, as tiktoken has it."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        size = len(data)
        if size <= self.leaf:
            return self.merge(data)
        half = size // 2
        if size <= self.leaf * 2:
            return self.join(self.merge(data[:half]), self.merge(data[half:]))
        return self.join(self._tree(data[:half]), self._tree(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


# A space inside a run of white space, or at the end of the text after white space.
_SPACE_IN_RUN = re.compile(r" (?<=\s )(?:\s|\Z)")


class _Memo(dict):
    """Packed ids of a chunk that stands after a space. Two generations are kept, so that frequent chunks stay."""

    def __init__(self, codec: "TextCodec"):
        self.codec, self.old = codec, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        found = self.old.pop(chunk, None)
        if found:
            self[chunk] = found
            return found
        codec = self.codec
        if chunk.isalpha():
            pieces = [" " + chunk]
        elif chunk[:-1].isalpha() and chunk[-1] in ",.":
            pieces = [" " + chunk[:-1], chunk[-1]]
        else:
            pieces = codec.pattern_of(chunk).findall(" " + chunk)
        if len(pieces) == 1:
            found = codec.packed(pieces[0])
        else:
            found = b"".join([self[p[1:]] if p[0] == " " and len(p) > 1 else codec.piece(p) for p in pieces])
        self[chunk] = found
        return found


class TextCodec:
    """Splits texts by a pattern and encodes each match; holds bounded tables of what is already encoded.

    With ``by_space`` the pattern must treat a space as GPT-2's does: it opens a match or lies in a run of white space, all of
    which but its last character is one match. Then a text may be cut before each space that has no white space
    on both sides (or before it, at the end), and each chunk is looked up as a whole.
    """

    def __init__(self, ranks_path: str, pattern: str, by_space: bool = True):
        self.codec, self.by_space = TreeCodec(load_ranks(ranks_path)), by_space
        # Small character classes are several times faster; they do for texts without characters beyond them.
        self.wide, self.narrow = compiled(pattern), compiled(pattern, 255)
        self.listed = [b",%d" % i for i in range(max(self.codec.token) + 1)]
        self.memo, self.pieces_memo = _Memo(self), {}

    def pattern_of(self, text: str) -> re.Pattern:
        if text.isascii():
            return self.narrow
        try:
            text.encode("latin-1")
            return self.narrow
        except UnicodeEncodeError:
            return self.wide

    def piece(self, match: str) -> bytes:
        found = self.pieces_memo.get(match)
        if found is None:
            if len(self.pieces_memo) >= MEMO_ENTRIES // 4:
                self.pieces_memo.clear()
            found = self.pieces_memo[match] = self.packed(match)
        return found

    def packed(self, match: str) -> bytes:
        return array("I", self.codec.encode(match.encode())).tobytes()

    def pieces(self, text: str):
        """Ids in order, as lists of a bounded number."""
        if self.by_space and not _SPACE_IN_RUN.search(text):
            chunks = text.split(" ")
            head = [self.piece(m) for m in self.pattern_of(chunks[0]).findall(chunks[0])]
            lookup = self.memo.__getitem__
            for start in range(1, len(chunks), 65536):
                yield array("I", b"".join([*head, *map(lookup, chunks[start:start + 65536])])).tolist()
                head = []
            if head:
                yield array("I", b"".join(head)).tolist()
            return
        found = self.pattern_of(text).finditer(text)
        while block := [self.piece(m.group()) for m in islice(found, 65536)]:
            yield array("I", b"".join(block)).tolist()

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids]

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes)."""
        of_ids, of_bytes, count = hashlib.sha256(), hashlib.sha256(), 0
        for ids in self.pieces(text):
            listed = b"".join(map(self.listed.__getitem__, ids))
            of_ids.update(listed if count else listed[1:])
            of_bytes.update(self.codec.decode(ids))
            count += len(ids)
        return count, of_ids.hexdigest(), of_bytes.hexdigest()


@lru_cache(1)
def worker_codec(ranks_path: str, pattern: str) -> TextCodec:
    """One codec for all tasks of a worker process, with what it has encoded."""
    return TextCodec(ranks_path, pattern)


def _text(col: str):
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of token ids) and ``n_tokens``. Null and empty texts have no ids.

    Every row is encoded by itself, so repeated rows repeat. Kept columns named like a result are replaced.
    """
    def start():
        codec = worker_codec(ranks_path, pattern)

        def work(columns):
            ids = [codec.encode(t) for t in columns["text"]]
            return [ids, [len(i) for i in ids]]

        return work

    return with_results(docs, {"text": _text(text_col)}, start, {"ids": "longs", "n_tokens": "long"}, keep)


def decode(rows: DataFrame, ranks_path: str, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ids. A null array decodes to no bytes."""
    def start():
        codec = TreeCodec(load_ranks(ranks_path))
        return lambda columns: [[codec.decode(i or []) for i in columns["ids"]]]

    return with_results(rows, {"ids": F.col(f"`{ids_col}`")}, start, {"decoded": "binary"}, keep)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: each text is encoded, and its ids are decoded again.

    Null and empty texts have no ids; both digests are then those of the empty string.
    """
    def start():
        codec = worker_codec(ranks_path, pattern)

        def work(columns):
            return [list(c) for c in zip(*map(codec.digests, columns["text"]))]

        return work

    return with_results(docs, {"text": _text(text_col)}, start, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, keep)
