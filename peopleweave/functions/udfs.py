"""Pluggable Python stages (Arrow batches) and SQL-facing registrations.

Everything else runs in the JVM; these exist because a model, exact NFKC or a table function for SQL
users has no built-in form.
"""
from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # Unicode's space separators, as SQL's trim takes them


def nfkc_udf():
    """Exact NFKC as an Arrow-batched UDF, for callers who need more than width folding."""
    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))
    return nfkc


def hashed_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Default embedder: signed hashed character trigrams, unit length. A blank text has the trigram of its padding."""
    @lru_cache(1 << 16)
    def cell(gram: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        return h % dimension, 1.0 if h >> 63 else -1.0

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            padded = f"  {text.lower()} "
            codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
            # Each distinct trigram is hashed once, at its first place, and counted.
            _, first, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_index=True, return_counts=True)
            at, sign = zip(*[cell(padded[j:j + 3]) for j in first.tolist()])
            out[i] = np.bincount(at, counts * np.array(sign), dimension)
            if not out[i].any():  # signs of a short text may cancel out; the padded text as a whole stands for it then
                at, sign = cell(padded)
                out[i, at] = sign
            out[i] /= np.linalg.norm(out[i])
        return out
    return embed


def embed_documents(docs: DataFrame, make_embedder: Callable[[], Callable] = hashed_embedder, batch: int = 50,
                    model: str = "hashed-trigram", zero_blank: bool = False) -> DataFrame:
    """person_id, doc_text -> vectors. The model is made once per task and fed ``batch`` texts at a time;
    rows for which it gives nothing are dropped. A null text goes to it as an empty one. With ``zero_blank`` the vector
    of a text that is not null and holds nothing but spaces is zero."""
    def blank(text) -> bool:
        return text is not None and not text.strip(SPACES)

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model_fn = make_embedder()
        for texts in batches:
            vectors = []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start:start + batch]
                made = [None if v is None else np.asarray(v, dtype=np.float32) for v in model_fn([t or "" for t in part])]
                vectors += [np.zeros_like(v) if zero_blank and v is not None and blank(t) else v for t, v in zip(part, made, strict=True)]
            yield pd.Series(vectors, index=texts.index)

    out = docs.select("person_id", F.col("updated_at").alias("embedded_at"), embed("doc_text").alias("embedding"))
    return out.filter(F.col("embedding").isNotNull()).select(
        "person_id", "embedding", F.lit(model).alias("model"), F.size("embedding").alias("dimension"), "embedded_at")


def overlap_scorer():
    """Default pair scorer: share of the query's words found in the candidate text; None without words."""
    def score(query: str, candidate: str):
        words = {w for w in query.lower().split() if w}
        if not words:
            return None
        found = words & set(candidate.lower().split())
        return len(found) / len(words), f"{len(found)} of {len(words)} query words"
    return score


def score_pairs(pairs: DataFrame, make_scorer: Callable[[], Callable] = overlap_scorer) -> DataFrame:
    """(query_id, person_id, intent_text, candidate_text) -> scored rows; a scorer answering None or raising
    leaves the pair out, so it keeps its heuristic score downstream."""
    id_types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            rows = []
            for q, p, intent, text in zip(frame["query_id"], frame["person_id"], frame["intent_text"], frame["candidate_text"]):
                try:
                    result = scorer(intent or "", text or "")
                except Exception:  # noqa: BLE001 - one failing pair must not fail the batch
                    result = None
                if result is not None:
                    rows.append((q, p, float(result[0]), result[1]))
            yield pd.DataFrame(rows, columns=["query_id", "person_id", "pair_score", "pair_reason"])

    schema = f"query_id {id_types['query_id']}, person_id {id_types['person_id']}, pair_score double, pair_reason string"
    return pairs.select("query_id", "person_id", "intent_text", "candidate_text").mapInPandas(run, schema)


def register_sql(spark: SparkSession) -> None:
    """Names for SQL users: scalar nfkc(text), table functions text_trigrams(text) and profile_evidence(json)."""
    spark.udf.register("nfkc", nfkc_udf())
    # Both are SQL functions, so their expressions become part of the caller's plan.
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION text_trigrams(value STRING) RETURNS TABLE(trigram STRING) RETURN
        SELECT explode(array_distinct(flatten(transform(regexp_extract_all(lower(coalesce(value, '')), '([\\\\p{L}\\\\p{N}]+)', 1),
            w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))) AS trigram""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION profile_evidence(payload STRING) RETURNS TABLE(evidence_type STRING, title STRING, description STRING) RETURN
        SELECT r.evidence_type, r.title, r.description FROM (SELECT explode(concat(
            transform(filter(coalesce(p.creations, array()), c -> coalesce(c.url, '') <> '' OR coalesce(c.title, '') <> ''),
                c -> named_struct('evidence_type', 'project', 'title', nullif(trim(c.title), ''), 'description', nullif(trim(c.description), ''))),
            transform(filter(coalesce(p.socials, array()), s -> trim(coalesce(s.content, '')) <> ''),
                s -> named_struct('evidence_type', 'social', 'title', s.type, 'description', trim(s.content))),
            transform(filter(array(named_struct('t', 'Current Doing', 'v', p.basicInfo.current_doing), named_struct('t', 'Role', 'v', p.basicInfo.role), named_struct('t', 'Skill', 'v', p.basicInfo.skill)),
                f -> trim(coalesce(f.v, '')) <> ''), f -> named_struct('evidence_type', 'profile_field', 'title', f.t, 'description', trim(f.v))))) AS r
          FROM (SELECT from_json(payload, 'creations ARRAY<STRUCT<url: STRING, title: STRING, description: STRING>>, socials ARRAY<STRUCT<type: STRING, content: STRING>>, basicInfo STRUCT<current_doing: STRING, role: STRING, skill: STRING>') AS p))""")
