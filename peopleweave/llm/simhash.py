"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are put into partitions, correlated bits together, and each partition gets its own threshold T >= -1. If the
thresholds add up to (allowed bits - partitions + 1), two fingerprints within the allowed bits are within T in some
partition (-1: not probed). Correlations and the collision counts behind the candidate estimates are taken over
all distinct fingerprints; dynamic programming picks the thresholds, and the cheapest number of partitions is kept.
Fingerprints are posted under their partition values, and probe all values within T; what meets is verified.

A bucket is never expanded into its pairs: its members are searched breadth first and leave one edge per member. Buckets
over ``BUCKET_ROWS`` are dealt as pairs of blocks, so that any two members still meet.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, with_results
from .components import roots

BITS = 3
SHINGLE = 3
BUCKET_ROWS = 20_000
ROW_COST, PAIR_COST = 1.0, 0.02   # of a posted or probing row, and of a verified pair


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash over word shingles of the text with A-Z in lower case; no words give 0."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
    ends, digest, counts = ends.tolist(), xxhash.xxh64_digest, np.zeros(64, np.int64)
    last = ends[shingle - 1:] if len(words) >= shingle else [len(text)]
    for start in range(0, n, 32768):
        hashes = b"".join([digest(text[a:b], 42) for a, b in zip(begins[start:start + 32768], last[start:start + 32768])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed 64-bit integer."""
    def start():
        return lambda columns: [[fingerprint(t, shingle) for t in columns["text"]]]

    return with_results(docs, {"text": utf8(text_col)}, start, {"fp": "long"}, keep)


def correlations(values: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together, over all of them."""
    def count(batches):
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at:at + (1 << 16)]
                total += (part.T @ part).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(4096), "n": total.ravel()})

    cells = values.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    together = np.zeros(4096, np.int64)
    for cell, n in cells:
        together[cell] = n
    return values.count(), together.reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for i in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - i)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, that add up to ``total`` at the lowest sum of costs."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, chosen + [t])
        best = step
    return best[total]


def _key(bits: list[int]):
    """The bits of ``fp`` packed into one number."""
    terms = [F.shiftleft(F.shiftrightunsigned("fp", 63 - b).bitwiseAND(F.lit(1)), len(bits) - 1 - i) for i, b in enumerate(bits)]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def plan(values: DataFrame, bits: int) -> list[tuple[list[int], int]]:
    """(bits of a partition, threshold) for the cheapest partitioning of the distinct fingerprints."""
    n, together = correlations(values)
    p = np.diag(together) / max(n, 1)
    layouts = {m: group_bits(n, together, m) for m in range(2, bits + 2)}
    slots = [(m, i, g) for m, groups in layouts.items() for i, g in enumerate(groups)]
    keys = values.select(F.posexplode(F.array(*[_key(g) for _, _, g in slots])).alias("slot", "key"))
    sizes = keys.groupBy("slot", "key").count()
    pairs = dict(sizes.groupBy("slot").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect())
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            agree = np.clip(p[g] ** 2 + (1 - p[g]) ** 2, 1e-6, 1)
            odds, elementary = (1 - agree) / agree, np.zeros(bits + 1)
            elementary[0] = 1
            for r in odds:
                elementary[1:] += r * elementary[:-1].copy()
            base = max(pairs.get(slots.index((m, i, g)), 0.0), n * n / 2 * float(np.prod(agree)))
            options = {-1: 0.0}
            for t in range(bits + 1):
                rows = n * sum(math.comb(len(g), j) for j in range(t + 1))
                options[t] = ROW_COST * rows + PAIR_COST * base * float(elementary[:t + 1].sum())
            costs.append(options)
        cost, thresholds = allocate(costs, bits - m + 1)
        if best is None or cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]
    return best[1]


def signatures(values: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): each fingerprint under all values within the threshold of its own, in each probed partition."""
    out = []
    for i, (g, t) in enumerate(layout):
        masks = [sum(1 << b for b in c) for j in range(t + 1) for c in combinations(range(len(g)), j)]
        key = F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.cast("long").bitwiseXOR(_key(g)))) if t else _key(g)
        out.append(values.select(F.lit(i).alias("part"), key.alias("key"), "fp"))
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    return rows


def stars(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(smallest, other) edges that connect what links of at most ``bits`` bits connect among the members."""
    rest, out = np.unique(members), []
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count((rest ^ frontier.pop()).view(np.uint64)) <= bits
            if near.any():
                found = rest[near].tolist()
                rest = rest[~near]
                out += [(root, f) for f in found]
                frontier += found
    return out


def _bucket_edges(bits: int):
    """Edges of sorted (part, key, block, fp) rows; only the bucket at the end of a batch is held back."""
    def solve(keys: np.ndarray, fps: np.ndarray):
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
        sizes = ends - begins
        group = np.repeat(np.arange(len(sizes)), sizes)
        linked = set(np.flatnonzero(sizes > 48).tolist())
        for shift in range(1, min(48, int(sizes.max(initial=1)))):   # small buckets: neighbours at each distance at once
            same = np.flatnonzero(group[shift:] == group[:-shift])
            near = np.bitwise_count((fps[same] ^ fps[same + shift]).view(np.uint64)) <= bits
            linked.update(group[same[near]].tolist())
        return [e for g in sorted(linked) for e in stars(fps[begins[g]:ends[g]], bits)]

    def batch_of(edges):
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["parent", "child"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            fps = batch.column(3).to_numpy()
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1   # begin of the last bucket here
            if held and (held[-1][0][-1] != keys[0]).any():
                yield batch_of(solve(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])))
                held = []
            if last:
                held.append((keys[:last], fps[:last]))
                yield batch_of(solve(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])))
                held = []
            held.append((keys[last:], fps[last:]))
        if held:
            yield batch_of(solve(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])))

    return run


def link_edges(values: DataFrame, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(parent, child) edges with the same components as all links between the distinct fingerprints ``fp``."""
    spark = values.sparkSession
    rows = signatures(values, plan(values, bits))
    full = rows.groupBy("part", "key").count().filter(F.col("count") > bucket_rows).select("part", "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks"))
    rows = rows.join(full, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block pair (i, j) with i <= j is block i * blocks + j.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    rows = rows.select("part", "key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(pairs)).alias("block"), "fp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return rows.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block").mapInArrow(_bucket_edges(bits), "parent long, child long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE,
                    keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the kept columns) with fp, component_fp (smallest fingerprint reachable) and component_id (smallest id reachable).

    Two documents are linked if their fingerprints differ in at most ``bits`` bits. Null and empty texts have fingerprint 0. Null ids are not
    counted as smallest; a component with null ids alone has a null component_id. Repeated rows each get their row.
    """
    kept = list(dict.fromkeys([*(docs.columns if keep is None else keep), id_col]))
    rows = stored(fingerprints(docs, text_col=text_col, shingle=shingle, keep=kept), "fingerprints")
    values = stored(rows.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("low")), "values")
    found = roots(stored(link_edges(values.select("fp"), bits), "links"))
    linked = found.select(F.col("child").alias("fp"), F.col("parent").alias("root")).unionByName(found.select(F.col("parent").alias("fp"), F.col("parent").alias("root")).distinct())
    lows = linked.join(values, "fp").groupBy("root").agg(F.min("low").alias("lowest"))
    classes = values.join(linked.join(lows, "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("component_fp"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    classes = stored(classes, "classes")   # read as a plain table, so that the join below can split a hot fingerprint
    return rows.drop("component_fp", "component_id").join(classes, "fp").select(*[c for c in rows.columns if c not in ("fp", "component_fp", "component_id")], "fp", "component_fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each group of linked documents: the smallest id (null ids last), and one only of repeated rows."""
    marked = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    groups = near_duplicates(marked, id_col=id_col, keep=[id_col, "__row"], **options)
    first = groups.groupBy("component_fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("first"))
    first = first.select(F.col("first.id").alias("__id"), F.col("first.row").alias("__row"))
    left = marked.join(first, (marked["__row"] == first["__row"]) & marked[id_col].eqNullSafe(first["__id"]), "left_semi")
    return left.dropDuplicates(["__row", id_col]).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_fingerprint(name: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(name))), 16, "0")
