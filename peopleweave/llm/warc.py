"""WARC archives of pages, and a globally ordered index of their capture histories.

Writing: equal payloads are found by their digest; the capture with the smallest id holds the payload (response), the others
refer to it (revisit). Each task writes its own archives, one gzip member a record. Reading back: each archive is read
record by record, and its captures, sorted by URL key, timestamp and id, become a local run in a file of its
own. The runs are merged by key range: a task seeks its range in every run and merges the runs with a tree of losers.
More runs than ``FAN_IN`` are first merged in groups, so that no task has more than ``FAN_IN`` runs open. Groups are merged by key range, too: each
range becomes a segment, a file of its own, and the segments of a group in key order are its run.
"""
from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import math
import re
import struct
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import positions
from .common import shared_folder, stored, utf8
from .sharing import reading, writing

ARCHIVE_BYTES = 64 << 20      # compressed bytes after which a task begins a new archive
FAN_IN = 64
RANGE_ROWS = 20_000           # about the captures in one range of the merged index
SEGMENTS = 4096               # about the files of a merged run at most
SPARSE = 256                  # captures between two entries of a run's own index
DATE = "2024-01-01T00:00:00Z"  # of captures without a time
NO_ID = "none"


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and query in lower case, without scheme, port 80 or 443, ``www.`` and fragment. Null is empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{where}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, date: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. ``refers_to`` is None for a response, else the id (or NO_ID) of the capture with the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{NO_ID if page_id is None else page_id}>", f"WARC-Date: {date}",
             *([f"WARC-Target-URI: {_header(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}",
             *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def records(stream):
    """(offset, compressed length, headers, block) of each gzip member of an archive."""
    at, rest = 0, b""
    while True:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    if used:
                        raise ValueError(f"archive ends inside the record at {at}")
                    return
            parts.append(inflate.decompress(rest))
            used += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or tail[size:] != b"\r\n\r\n":
            raise ValueError(f"no whole record at {at}")
        yield at, used, headers, tail[:size]
        at += used


def _page_of(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == NO_ID else int(name)


def capture(file: str, at: int, length: int, headers: dict, block: bytes) -> list:
    """Index entry of a record: key, date, page id and the rest. A response's digest is computed from its payload and compared."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size, revisit = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["WARC-Type"] == "revisit"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of the record at {at} of {file} is damaged")
    page, url = _page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI")
    return [[url_key(url), headers["WARC-Date"], page is None, page or 0, at, file], url, size, digest, headers["WARC-Type"], _page_of(headers["WARC-Refers-To"]) if revisit else None, length]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the root's winner goes out next."""

    def __init__(self, sources: list, key=lambda x: x):
        self.sources, self.key, self.k = [iter(s) for s in sources], key, max(1, len(sources))
        self.heads = [next(s, None) for s in self.sources] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k      # losers[0] is the winner of all
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Source a goes before b; sources not yet entered (-1) win, ended ones lose, ties go to the lower number."""
        if a < 0 or b < 0:
            return a < 0
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while True:
            i = self.losers[0]
            if i < 0 or self.heads[i] is None:
                return
            yield self.heads[i]
            head = next(self.sources[i], None)
            self.heads[i], self.keys[i] = head, None if head is None else self.key(head)
            self._play(i)


class RunWriter:
    """Writes sorted captures as lines with a sparse index and a footer."""

    def __init__(self, stream):
        self.stream, self.at, self.count, self.sparse = stream, 0, 0, []

    def add(self, entry: list) -> None:
        if self.count % SPARSE == 0:
            self.sparse.append([entry[0], self.at])
        line = json.dumps(entry, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
        self.stream.write(line)
        self.at += len(line)
        self.count += 1

    def close(self) -> None:
        self.stream.write(json.dumps(self.sparse, ensure_ascii=False).encode() + struct.pack("<QQ", self.at, self.count))


class Run:
    """A sorted run on the shared disk."""

    def __init__(self, uri: str):
        self.file = reading(uri)
        size = self.file.size()
        self.end, self.count = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.sparse = json.loads(self.file.read_at(size - 16 - self.end, self.end))

    def entries(self, low: list | None = None, high: list | None = None):
        """Captures with low <= key < high, in order."""
        at = 0
        if low is not None and self.sparse:
            at = self.sparse[max(0, bisect.bisect_left(self.sparse, [low, -1]) - 1)][1]
        rest = b""
        while at < self.end or rest:
            if at < self.end:
                block = self.file.read_at(min(1 << 18, self.end - at), at)
                at += len(block)
                rest += block
            whole, _, rest = rest.rpartition(b"\n")
            for line in whole.split(b"\n") if whole else ():
                entry = json.loads(line)
                if high is not None and not entry[0] < high:
                    return
                if low is None or not entry[0] < low:
                    yield entry


def overlapping(segments: list, low: list | None, high: list | None) -> list[str]:
    """Files of the segments, each with the key it begins at (None: the least) and in key order, that may hold captures with low <= key < high."""
    ends = [begin for begin, _ in segments[1:]] + [None]
    return [uri for (begin, uri), end in zip(segments, ends) if (high is None or begin is None or begin < high) and (low is None or end is None or low < end)]


def merged(runs: list[list[str]], low: list | None = None, high: list | None = None):
    """Captures of all runs, each a list of files in key order, in one order. Of each run one file is open at a time."""
    return iter(LoserTree([(e for uri in files for e in Run(uri).entries(low, high)) for files in runs], key=lambda e: e[0]))


def key_ranges(keys: list[str], captures: int, range_rows: int) -> list[tuple]:
    """(low, high) of ranges of about ``range_rows`` captures each, from a sample of keys as JSON; the first is open below, the last above."""
    keys = sorted(map(json.loads, keys))
    parts = min(max(1, math.ceil(captures / range_rows)), len(keys) or 1)
    cuts = [keys[i * len(keys) // parts] for i in range(1, parts)]
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
    return list(zip([None, *cuts], [*cuts, None]))


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE,
                   least_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC archives; returns (archive, records), a row per archive.

    Null html is an empty payload, and empty payloads are equal payloads too. Among equal payloads of at least ``least_revisit_bytes`` bytes all
    rows with the smallest id are responses and the others revisits; a null id counts as larger than any other. Repeated
    rows are repeated captures. No pages give no archives.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), utf8(html_col).alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    # Only payloads that occur more than once go into the join.
    firsts = rows.filter(F.length("payload") >= least_revisit_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")
    rows = rows.join(firsts.withColumn("several", F.lit(True)), "sha1", "left")
    first = F.coalesce("several", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select("id", "url", "payload", "sha1", F.when(first, F.coalesce(F.col("first").cast("string"), F.lit(NO_ID))).alias("refers_to"))

    def write(batches):
        part, serial, batch, row = TaskContext.get().partitionId(), 0, None, 0
        source = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(5)]))
        page = next(source, None)
        while page is not None:
            uri, count, size = f"{folder}/warc/part-{part:06d}-{serial:04d}.warc.gz", 0, 0
            with writing(uri) as f:
                while page is not None and size < ARCHIVE_BYTES:
                    page_id, url, payload, sha1, refers_to = page
                    data = record(page_id, url, date, payload, base64.b32encode(sha1).decode(), refers_to)
                    f.write(data)
                    size, count, page = size + len(data), count + 1, next(source, None)
            serial += 1
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": [count]})

    return stored(rows.mapInArrow(write, "archive string, records long"), "archives")


def _per_row(df: DataFrame, *columns: str) -> DataFrame:
    """One partition for about each row of a table with a row per file."""
    return df.repartitionByRange(max(1, df.count()), *columns)


def sorted_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Read each archive back and write its captures as a sorted run; returns (run, captures, sample of keys)."""
    def sort(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with io.BufferedReader(reading(uri), 1 << 20) as stream:
                    entries = sorted((capture(uri, *r) for r in records(stream)), key=lambda e: e[0])
                run = uri.replace("/warc/", "/runs/").removesuffix(".warc.gz") + ".run"
                with writing(run) as f:
                    out = RunWriter(f)
                    for e in entries:
                        out.add(e)
                    out.close()
                keys = [json.dumps(e[0]) for e in entries[::max(1, len(entries) // 32)]]
                yield pa.RecordBatch.from_pydict({"run": [run], "captures": [len(entries)], "keys": [keys]})

    return stored(_per_row(archives.select("archive"), "archive").mapInArrow(sort, "run string, captures long, keys array<string>"), "runs")


def _merge_groups(runs: DataFrame, folder: str, level: int, fan_in: int, range_rows: int) -> DataFrame:
    """One pass: each ``fan_in`` runs become one, a task merging one key range of a group. A segment is the JSON of the key it begins at and its file.

    Ranges grow with the group beyond ``SEGMENTS`` of them, so that a row that lists the segments of a run stays small.
    """
    numbered = positions(runs, [], ["run"], "at").withColumn("g", F.floor((F.col("at") - 1) / fan_in))
    groups = numbered.groupBy("g").agg(F.collect_list(F.struct("run", "segments")).alias("runs"), F.sum("captures").alias("captures"), F.flatten(F.collect_list("keys")).alias("keys"))

    def plan(batches):
        for batch in batches:
            for g, members, captures, keys in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                segments = [[json.loads(x) for x in m["segments"]] for m in sorted(members, key=lambda m: m["run"])]
                for r, (low, high) in enumerate(key_ranges(keys, captures, max(range_rows, captures // SEGMENTS))):
                    yield pa.RecordBatch.from_pydict({"g": [g], "r": [r], "work": [json.dumps([low, high, [overlapping(x, low, high) for x in segments]])]})

    planned = stored(_per_row(groups.select("g", "runs", "captures", "keys"), "g").mapInArrow(plan, "g long, r long, work string"), "ranges")

    def merge(batches):
        for batch in batches:
            for g, r, work in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                low, high, files = json.loads(work)
                uri = f"{folder}/runs/level{level}-{g:06d}-{r:06d}.run"
                with writing(uri) as f:
                    out = RunWriter(f)
                    for e in merged(files, low, high):
                        out.add(e)
                    out.close()
                    keys = [json.dumps(k) for k, _ in out.sparse[::max(1, len(out.sparse) // 32)]]
                yield pa.RecordBatch.from_pydict({"g": [g], "r": [r], "captures": [out.count], "keys": [keys], "segment": [json.dumps([low, uri])]})

    written = stored(_per_row(planned, "g", "r").mapInArrow(merge, "g long, r long, captures long, keys array<string>, segment string"), "segments")
    inner = F.array_sort(F.collect_list(F.struct("r", "segment")))
    every = F.flatten(F.collect_list("keys"))
    return stored(written.groupBy("g").agg(F.sum("captures").alias("captures"), every.alias("keys"), inner.alias("s")).select(
        F.format_string(f"level{level}-%012d", "g").alias("run"), "captures", "keys", F.col("s.segment").alias("segments")), "runs")


INDEX_SCHEMA = ("range long, position long, url_key string, date string, page_id long, url string, archive string, offset long, length long, payload_bytes long, "
                "payload_digest string, record_type string, refers_to long")


def merge_runs(runs: DataFrame, folder: str, *, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in global order: (range, position) ascending is URL key, date and id ascending."""
    level = 0
    runs = runs.select("run", "captures", "keys", F.array(F.concat(F.lit("[null,"), F.regexp_extract(F.to_json(F.struct("run")), r'^\{"run":(.*)\}$', 1), F.lit("]"))).alias("segments"))
    while runs.count() > fan_in:
        level += 1
        runs = _merge_groups(runs, folder, level, fan_in, range_rows)
    spark, rows = runs.sparkSession, sorted(runs.select("run", "captures", "keys", "segments").collect())   # at most FAN_IN rows of about SEGMENTS segments
    segments = [[json.loads(x) for x in r["segments"]] for r in rows]
    spans = key_ranges([k for r in rows for k in r["keys"]], sum(r["captures"] for r in rows), range_rows)
    bounds = [json.dumps([low, high, [overlapping(x, low, high) for x in segments]]) for low, high in spans]
    ranges = spark.createDataFrame(list(enumerate(bounds)), "r long, bounds string")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

    def merge(batches):
        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high, files = json.loads(text)
                rows, position = [], 0
                for (key, date, none, page, at, file), url, size, digest, kind, refers, length in merged(files, low, high):
                    rows.append((r, position, key, date, None if none else page, url, file, at, length, size, digest, kind, refers))
                    position += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return ranges.repartitionByRange(len(bounds), "r").mapInArrow(merge, INDEX_SCHEMA)


def read_payload(archive: str, offset: int, length: int) -> bytes:
    """Payload of one response by its index entry."""
    _, _, _, block = next(records(io.BytesIO(reading(archive).read_at(length, offset))))
    return block.partition(b"\r\n\r\n")[2]


def capture_index(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write archives of ``pages`` and return the globally ordered index of what is read back from them."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return merge_runs(sorted_runs(write_archives(pages, folder, **options), folder), folder)
