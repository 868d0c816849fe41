"""Search index over person documents: rows in blocks, and postings from grams and terms to the blocks that hold them.

Blocks are parts of ranges of (source, length of the text), so that the length bound of a set similarity and source filters can leave whole blocks out. The index
is a pair of ordinary tables; it is built once and serves any number of query tables.

A query meets a block if the grams they share allow a similarity above the threshold for the shortest rows of the block, or if the block holds one of the
query's terms. The count of shared grams is an equi-join on the gram with partial aggregation: its rows are posted per block, not per
person, so a gram that everybody has costs one row per block and query instead of one per person and query.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import or_empty, single
from ..functions.text import normalize_index_text
from ..session import stored
from .scan import gram_lists

BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 2_048, 16 << 20, 256
NO_STRINGS = "array<string>"
PIECE_CHARS, PIECE_ROWS = 1 << 20, 1_024
_SPACE = 32
_kinds = np.zeros(0x110000, np.uint8)  # per code point: 0 not seen yet, 1 gap, 2 letter or digit


@dataclass(frozen=True)
class SearchIndex:
    """rows: (person_id, block, sources, place_text, norm, roles, tags, names, heads, grams as packed codes); grams and terms: (key, block); blocks: (block, least); count: block numbers."""
    rows: DataFrame
    grams: DataFrame
    terms: DataFrame
    blocks: DataFrame
    count: int


def _codes(text: str) -> np.ndarray:
    """Code points of a text, gaps between words as spaces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for point in np.unique(points[_kinds[points] == 0]).tolist():
        _kinds[point] = 2 if chr(point).isalnum() else 1
    return np.where(_kinds[points] == 2, points, _SPACE).astype(np.int64)


def _piece_grams(texts: list[str]) -> list[np.ndarray]:
    at = _codes("".join(f"{t}\n" for t in texts))
    before = np.concatenate([[_SPACE], at[:-1]])
    # A word begins after two spaces, however short the word before it is.
    first = np.where(before == _SPACE, _SPACE, np.concatenate([[_SPACE, _SPACE], at[:-2]])[:len(at)])
    grams, real = first << 42 | before << 21 | at, (at != _SPACE) | (before != _SPACE)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return [np.unique(grams[a:b][real[a:b]]) for a, b in zip([0, *ends[:-1]], ends)]


def texts_grams(norms: list[str | None]) -> Iterator[np.ndarray]:
    """Codes of the distinct padded trigrams of each normalised text, sorted; a piece of the texts is worked on at a time."""
    piece, size = [], 0
    for norm in norms:
        piece.append(norm or "")
        size += len(piece[-1])
        if size >= PIECE_CHARS:
            yield from _piece_grams(piece)
            piece, size = [], 0
    if piece:
        yield from _piece_grams(piece)


def text_grams(norm: str) -> np.ndarray:
    """``texts_grams`` of one text."""
    return next(texts_grams([norm]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)


def _with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        grams = [g.tobytes() for g in texts_grams(batch.column(batch.schema.get_field_index("norm")).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grams, pa.binary())], names=[*batch.schema.names, "grams"])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (block, key) of each piece of a batch."""
    for batch in _pieces(batches):
        blocks, grams = np.asarray(batch.column(0)), gram_lists(batch.column(1))
        codes, offsets = np.asarray(grams.flatten()), np.asarray(grams.offsets)
        order = np.argsort(blocks, kind="stable")
        numbers, starts = np.unique(blocks[order], return_index=True)
        keys = [np.unique(np.concatenate([codes[offsets[i]:offsets[i + 1]] for i in rows])) for rows in np.split(order, starts[1:])]
        of = np.repeat(numbers, [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.concatenate(keys), pa.int64())], names=["block", "key"])


def filter_columns(docs: DataFrame, text: bool = True) -> DataFrame:
    """Active persons with the columns that filters need."""
    place = F.lower(F.array_join(F.concat(or_empty("facet_location"), single("location")), "\n"))
    return docs.filter("status = 'active'").withColumns({"sources": F.transform(or_empty("facet_source"), F.lower), "place_text": place,
                                                         "norm": normalize_index_text("doc_text") if text else F.lit("")})


def build_index(docs: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> SearchIndex:
    """docs: (person_id, name, doc_text, facet_role, facet_location, facet_source, facet_tags, location, status), one row per person.

    A source and power of two of the text length is one range; it is dealt by a hash of the id into as many blocks as its rows and bytes ask for,
    or as the cores of the cluster do, while blocks keep ``LEAST_ROWS`` rows. Small ranges share a block with their neighbours.
    """
    spark = docs.sparkSession
    lower = lambda c: F.transform(or_empty(c), F.lower)
    size = F.coalesce(F.octet_length("doc_text"), F.lit(0))
    base = docs.filter("status = 'active'").select("person_id", "name", "doc_text", "location", "facet_location", "facet_source", lower("facet_role").alias("roles"),
                                                   lower("facet_tags").alias("tags"), "status", F.coalesce(F.lower(F.get("facet_source", F.lit(0))), F.lit("")).alias("source"),
                                                   F.floor(F.log2(size + 1)).cast("int").alias("length"))
    base = stored(base, "search-docs")
    ranges = base.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    whole, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("source", "length")
    rows = F.sum("n").over(whole)
    spread = F.least(F.lit(2.0 * spark.sparkContext.defaultParallelism), rows / LEAST_ROWS) / rows
    weight = F.greatest(F.col("n") / block_rows, F.col("bytes") / block_bytes, F.col("n") * spread)
    # A row per source and power of two: a small table, numbered in one window. Small ranges next to each other share a block.
    ranges = ranges.withColumn("weight", weight).withColumn("upto", F.sum("weight").over(upto))
    ranges = ranges.select("source", "length", F.floor(F.col("upto") - F.col("weight")).cast("int").alias("before"), F.greatest(F.lit(1), F.ceil("weight")).cast("int").alias("splits"))
    ranges = stored(ranges, "index-ranges")
    n = ranges.agg(F.coalesce(F.max(F.col("before") + F.col("splits")), F.lit(0))).first()[0]
    ranged = base.join(ranges, ["source", "length"]).withColumn(
        "block", (F.col("before") + F.pmod(F.xxhash64("person_id"), "splits")).cast("int"))
    name = normalize_index_text("name")
    # A name prefix match needs a further word after the query, so one-word names have no head.
    head = F.when(name.contains(" "), F.array(F.split(name, " ")[0])).otherwise(F.array().cast(NO_STRINGS))
    shaped = filter_columns(ranged).select("person_id", "block", "sources", "place_text", "norm",
                                           "roles", "tags", F.array_compact(F.array(name)).alias("names"), F.coalesce(head, F.array().cast(NO_STRINGS)).alias("heads"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shaped.schema.fields)
    # Rows of a block lie together, so that its postings are distinct but for a few pieces before they are shuffled.
    placed = shaped.repartition(max(min(n, 2 * spark.sparkContext.defaultParallelism), n // 4, 1), "block")
    table = stored(placed.mapInArrow(_with_grams, schema + ", grams binary"), "search-index")
    grams = stored(table.select("block", "grams").mapInArrow(_block_grams, "block int, key long").distinct(), "gram-postings")
    keys = F.concat(*[_marked(k, F.col(c)) for k, c in (("r", "roles"), ("t", "tags"), ("s", "sources"), ("n", "names"), ("h", "heads"))])
    terms = stored(table.select("block", F.explode(keys).alias("key")).distinct(), "term-postings")
    return SearchIndex(table, grams, terms, stored(table.groupBy("block").agg(F.min((F.octet_length("grams") / 8).cast("int")).alias("least")), "blocks"), n)


def _marked(kind: str, terms: Column) -> Column:
    """Terms of one channel as posting keys."""
    return F.transform(terms, lambda x: F.concat(F.lit(f"{kind}:"), x))


def gram_key(gram: Column) -> Column:
    """``gram_code`` as a column; null for less than three characters."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return F.when(F.length(gram) == 3, F.shiftleft(at(1), 42).bitwiseOR(F.shiftleft(at(2), 21)).bitwiseOR(at(3)))


def meeting_blocks(prepared: DataFrame, index: SearchIndex, threshold: float) -> DataFrame:
    """(query_id, block): every block that may hold a candidate of the query, and few others."""
    texts = F.concat("skill_terms", "lead_terms", "open_terms")
    usable = prepared.filter(F.col("keyword_query") != "")
    asked = usable.select("query_id", F.size("grams").alias("n"), F.explode("grams").alias("g")).select("query_id", "n", gram_key(F.col("g")).alias("key"))
    shared = asked.join(index.grams, "key").groupBy("query_id", "n", "block").agg(F.count(F.lit(1)).alias("shared")).join(index.blocks, "block")
    most = F.col("shared") / (F.col("n") + F.greatest("least", "shared") - F.col("shared"))
    alike = shared.filter(most > threshold).select("query_id", "block")

    name = F.array("norm_query")
    keys = F.concat(_marked("r", F.col("exp_roles")), _marked("t", F.col("exp_skills")), _marked("n", name), _marked("h", name))
    by_term = usable.select("query_id", F.explode(keys).alias("key")).join(index.terms, "key").select("query_id", "block")
    inner = F.regexp_extract("term", r"[\p{L}\p{N}]{3}", 0)
    terms = usable.select("query_id", F.explode(texts).alias("term")).select("query_id", inner.alias("g"))
    by_text = terms.filter("g <> ''").select("query_id", gram_key(F.col("g")).alias("key")).distinct().join(index.grams, "key").select("query_id", "block")
    # A term without three letters in a row may hide anywhere.
    anywhere = terms.filter("g = ''").select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(max(index.count - 1, 0)))).alias("block"))
    pairs = alike.unionByName(by_term).unionByName(by_text).unionByName(anywhere).distinct()

    sources = prepared.filter(F.size("want_sources") > 0).select("query_id", F.explode(_marked("s", F.col("want_sources"))).alias("key"))
    held = sources.join(index.terms, "key").select("query_id", "block").distinct().withColumn("_held", F.lit(True))
    free = prepared.select("query_id", (F.size("want_sources") == 0).alias("_free"))
    return pairs.join(free, "query_id").join(held, ["query_id", "block"], "left").filter(F.col("_free") | F.coalesce("_held", F.lit(False))).select("query_id", "block")
