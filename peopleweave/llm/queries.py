"""Registered queries of the operators of this subpackage and, where SQL can express them, their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontamination, hard_negatives, html_blocks, permutation_index, quality, sharding, simhash, suffix_tree, token_files, toxicity, warc
from .common import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_WORDS = (r"list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")


@query("op1_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format('text')}, []) AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM
  (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT m FROM wins),
spots AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM
  (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= m)),
found AS (SELECT s.r, s.i, s.m, w.item_id FROM spots s JOIN wins w ON s.m = w.m AND s.k = w.k),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM
  (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8, keep=["doc_id"])


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, dictionary = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest, dictionary).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=toxicity.learnable())
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op7_suffix_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree.score(docs, fold("doc_id", 7) != 2, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_permutation_index")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT h, first, unhex(sha1(h)) AS b FROM f)
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(('0b' || substr(bits, 1 + 5 * i, 5)) AS INTEGER) AS INTEGER), 1), '' ORDER BY i) FROM (SELECT unnest(range(0, 32)) AS i)) AS payload_digest,
  CASE WHEN p.page_id = d.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id = d.first THEN NULL ELSE d.first END AS refers_to
FROM p JOIN (SELECT *, CAST(b AS BIT)::VARCHAR AS bits FROM d) d ON p.h = d.h""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


_SOUND = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_hard_negatives", f"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_SOUND}),
rows AS (SELECT id, min((label, v)) AS x FROM r GROUP BY id),
c AS (SELECT id, x[1] AS label, x[2] AS v FROM rows),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM c a JOIN c b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS positive, p.score AS ps, s.b AS negative, s.score AS ns,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 3""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label=label)


def _fence_sql(keys: str, name: str) -> str:
    """Quartiles of the sketches of one level as a DuckDB CTE."""
    by = f"{keys}, " if keys else ""
    return f"""{name}_s AS (SELECT {by}figure, place, sum(n) AS n FROM sk GROUP BY {by}figure, place),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {by}figure ORDER BY place) AS upto, sum(n) OVER (PARTITION BY {by}figure) AS total FROM {name}_s),
{name} AS (SELECT {by}figure, max(total) AS n, min(place) FILTER (4 * upto >= total) AS q1, min(place) FILTER (4 * upto >= 3 * total) AS q3 FROM {name}_u GROUP BY {by}figure)"""


@query("op12_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
nrep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM w),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(nrep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN ln USING (r) LEFT JOIN nrep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate FROM m),
x AS (SELECT r, lang, source, base_failed, unnest(['word_length', 'symbol_rate', 'dup_line_rate', 'repeat_rate']) AS figure, unnest([word_length, symbol_rate, dup_line_rate, repeat_rate]) AS v FROM f),
sk AS (SELECT lang, source, figure, (v >> greatest(length(bin(v)) - 8, 0)::INTEGER) << greatest(length(bin(v)) - 8, 0)::INTEGER AS place, count(*) AS n FROM x WHERE NOT base_failed GROUP BY ALL),
{_fence_sql('lang, source', 'g')}, {_fence_sql('lang', 'la')}, {_fence_sql('', 'co')},
e AS (SELECT g.lang, g.source, g.figure, CASE WHEN g.n >= 100 THEN g.q1 WHEN la.n >= 100 THEN la.q1 ELSE co.q1 END AS q1, CASE WHEN g.n >= 100 THEN g.q3 WHEN la.n >= 100 THEN la.q3 ELSE co.q3 END AS q3
  FROM g JOIN la ON g.lang IS NOT DISTINCT FROM la.lang AND g.figure = la.figure JOIN co ON g.figure = co.figure),
b AS (SELECT *, 3 * greatest(q3 - q1, CASE figure WHEN 'word_length' THEN 150 WHEN 'symbol_rate' THEN 50 WHEN 'dup_line_rate' THEN 150 ELSE 120 END) AS wide FROM e),
v AS (SELECT x.r, bool_and(x.v <= q3 + wide AND (x.figure <> 'word_length' OR x.v >= q1 - wide)) AS inside
  FROM x JOIN b ON x.lang IS NOT DISTINCT FROM b.lang AND x.source IS NOT DISTINCT FROM b.source AND x.figure = b.figure GROUP BY x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM f LEFT JOIN v USING (r)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
