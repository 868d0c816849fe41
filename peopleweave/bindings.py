"""Bindings of the driver's tables to profile-shaped relations.

Each relation exists twice: as a DataFrame (``Tables`` method) and as a SQL CTE (``CTE``)
with the same rows, so a registered query and its oracle start from equal inputs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.common import spread

NOW = "2001-09-01 00:00:00"        # after the newest order
EVENT_NOW = "2024-01-31 00:00:00"  # after the newest event
DOC_BASE = "2024-01-01 00:00:00"
TAG_WORDS = ["the", "and", "der", "que", "para", "les"]

# Tables whose rows hold long texts, with their key.
_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}

# (name, SQL, names it needs)
_CTE: dict[str, tuple[str, list[str]]] = {}


def _cte(name, sql, needs=()):
    _CTE[name] = (sql, list(needs))


def half(key) -> Column:
    """One of two roles of a row, such as stored and new, by a hash of its key: both grow with the table."""
    return F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1) < "8"


HALF = "substr(md5(CAST({0} AS VARCHAR)), 1, 1) < '8'"


def with_sql(names, body: str, extra: str = "") -> str:
    """``WITH`` clause holding the named relations and everything they need, then the body."""
    ordered: list[str] = []

    def visit(name):
        for need in _CTE[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_CTE[n][0]})" for n in ordered] + ([extra.strip()] if extra else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields
                    if f.dataType.typeName() == "timestamp_ntz"}
        df = df.withColumns(zoneless) if zoneless else df
        return spread(df, _TEXT_KEYS[name]) if name in _TEXT_KEYS else df

    def places(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def persons(self) -> DataFrame:
        spans = self.raw("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))
        bal = F.col("c_acctbal")
        epoch = F.lit("1995-01-01 00:00:00").cast("timestamp")
        return (self.raw("customer").join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
                .join(spans, F.col("o_custkey") == F.col("c_custkey"), "left")
                .select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"),
                        F.col("c_mktsegment").alias("headline"),
                        F.when(bal >= 0, F.concat(F.lit("account in "), F.col("r_name"))).alias("summary"),
                        F.concat_ws(" / ", "r_name", "n_name").alias("location"),
                        F.when(bal < 0, "hidden").when(bal > 9000, "claimed").otherwise("active").alias("status"),
                        (F.greatest(bal, F.lit(0.0)) / 10000).alias("confidence"),
                        F.coalesce("first_at", epoch).alias("created_at"),
                        F.coalesce("last_at", epoch).alias("updated_at")))

    def evidence(self) -> DataFrame:
        flag, pri = F.col("l_returnflag"), F.col("o_orderpriority")
        return (self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
                .select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    F.col("l_quantity").cast("int")).alias("evidence_id"),
                        F.col("o_custkey").alias("person_id"),
                        F.when(flag == "A", "bonjour").when(flag == "N", "github").otherwise("web").alias("source"),
                        F.when(pri == "1-URGENT", "project").when(pri == "2-HIGH", "repository")
                        .when(pri == "3-MEDIUM", "experience").when(pri == "5-LOW", "profile_field")
                        .otherwise("job_signal").alias("evidence_type"),
                        F.col("p_name").alias("title"), F.lower("p_type").alias("description"),
                        F.when(F.col("l_linestatus") == "O", F.concat(
                            F.lit("https://made.example/p/"), F.col("p_partkey"))).alias("url"),
                        F.col("o_orderdate").alias("occurred_at"), F.col("l_shipdate").alias("created_at"),
                        F.lower("p_brand").alias("language"),
                        F.when(F.col("p_size") < 25, "role").otherwise("location").alias("field"),
                        F.col("l_quantity").alias("followers")))

    def search_docs(self) -> DataFrame:
        d, lab = self.raw("documents"), self.raw("labels")
        lab = lab.select(F.col("doc_id").alias("lab_id"), "quality", "toxic")
        lower, src = F.lower("text"), F.col("source")
        return (d.join(lab, F.col("doc_id") == F.col("lab_id"), "left")
                .select(F.col("doc_id").alias("person_id"),
                        F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("name"),
                        F.concat_ws(" writer in ", "source", "lang").alias("headline"),
                        F.col("lang").alias("location"), F.col("text").alias("doc_text"),
                        F.array(F.lit("writer"), F.col("lang")).alias("facet_role"),
                        F.array(F.col("lang"), F.concat(F.lit("lang / "), F.col("lang"))).alias("facet_location"),
                        F.when(src.isin("src0", "src1", "src2", "src3"), F.array(src, F.lit("github")))
                        .when(src.isin("src3", "src4", "src5"), F.array(src, F.lit("bonjour")))
                        .otherwise(F.array(src)).alias("facet_source"),
                        F.array_compact(F.array(*[F.when(lower.contains(w), F.lit(w)) for w in TAG_WORDS]))
                        .alias("facet_tags"),
                        F.when(F.col("toxic") == 1, "hidden").when(F.col("quality") == 0, "claimed")
                        .otherwise("active").alias("status"),
                        F.floor(F.col("n_chars") / 50).cast("int").alias("freshness"),
                        F.expr(f"timestamp'{DOC_BASE}' + make_interval(0,0,0,0,0,0,n_chars)").alias("updated_at")))

    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("person_id"), "embedding", "label",
            F.expr(f"timestamp'{DOC_BASE}' + make_interval(0,0,0,0,0,0,2000 + label*100)").alias("embedded_at"))

    def queries(self) -> DataFrame:
        size = F.length("text")
        none = F.array().cast("array<string>")
        return self.raw("benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"),
            F.when(size % 2 == 0, F.array(F.lit("writer"))).otherwise(none).alias("roles"),
            F.array(F.lower(F.regexp_extract("text", r"^([^\s.,]+)", 1)), F.when(size % 3 == 0, "ring").when(
                size % 3 == 1, "widget").otherwise("gear")).alias("skills"),
            F.when(size % 7 == 0, F.array(F.lit("en"))).otherwise(none).alias("locations"),
            F.when(size % 5 == 0, F.array(F.lit("of the"))).otherwise(none).alias("must_haves"),
            none.alias("nice_to_haves"),
            F.when(size % 6 == 0, "github").alias("source_bias"))

    def query_vectors(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id")).join(
            self.raw("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")

    def viewer_events(self) -> DataFrame:
        kind = F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            "event_id", F.col("user_id").alias("viewer_id"), k.alias("person_id"),
            F.when(kind == "view", "detail_view").when(kind == "click", "evidence_expand")
            .when(kind == "purchase", "contacted").when(kind == "signup", "interested")
            .otherwise("not_interested").alias("kind"),
            F.when(k < 30, F.array(F.lit("ai_agents"), F.lit("open_source"))).when(k < 60, F.array(F.lit("robotics")))
            .otherwise(F.array().cast("array<string>")).alias("tags"), F.col("ts"), "value")

    def surfaced_events(self) -> DataFrame:
        """Every event with a value above 100 also counts as the candidate having been surfaced."""
        return self.viewer_events().filter(F.col("value") > 100).select(
            F.col("event_id"), "viewer_id", "person_id", F.lit("surfaced").alias("kind"),
            F.array().cast("array<string>").alias("tags"), "ts", "value")

    def all_viewer_events(self) -> DataFrame:
        return self.viewer_events().unionByName(self.surfaced_events())

    def feedback(self) -> DataFrame:
        kind = F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            F.col("event_id").alias("feedback_id"), "user_id", k.alias("person_id"),
            F.when(kind == "error", "negative").when(kind.isin("purchase", "signup"), "positive")
            .otherwise("neutral").alias("sentiment"),
            F.when(k < 20, "skill_mismatch").when(k < 40, "location_mismatch").when(k < 60, "experience_mismatch")
            .when(k < 80, "not_active").alias("reason_code"), F.col("ts").alias("created_at"))

    def memories(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        k = F.get_json_object("props", "$.k").cast("bigint")
        source = F.when(value > 20, "inferred").otherwise("explicit")
        return self.raw("events").select(
            F.col("event_id").alias("memory_id"), "user_id",
            F.when(kind == "view", "preference").when(kind == "click", "feedback")
            .when(kind == "purchase", "hiring_context").otherwise("preference").alias("kind"),
            F.when(k < 50, "global").otherwise("role").alias("scope_kind"),
            F.when(k >= 50, F.concat(F.lit("role"), k % 5)).alias("scope_value"),
            F.array(F.concat(F.lit("tech"), k % 7)).alias("tech_stack"),
            F.when(k % 3 == 0, F.array(F.concat(F.lit("city"), k % 4))).alias("locations"),
            F.when(k % 4 == 0, F.concat(F.lit("role"), k % 5)).alias("role"),
            F.when(k < 10, "avoidInactive").alias("preference_key"),
            source.alias("source"), F.col("ts").alias("updated_at"),
            F.when(value > 20, F.col("ts") + F.expr("interval 10 days")).alias("expires_at"))

    def claims(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("person_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "email").otherwise("github").alias("method"),
            F.when(s == "O", "pending").when(s == "F", "approved").otherwise("revoked").alias("status"),
            F.col("o_orderdate").alias("submitted_at"),
            F.when(s == "F", F.col("o_orderdate") + F.expr("interval 1 day")).alias("verified_at"))

    def _payloads(self, name: str, key: str, nation: str, payload) -> DataFrame:
        """Rows of a narrow table as JSON text. They are dealt to all cores before their payloads are made: a join that broadcasts the
        table has the tasks of the nations, and a file has no more than its row groups, however many rows there are."""
        rows = self.raw(name)
        parts = max(self.spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
        return (rows.join(self.places(), F.col(nation) == F.col("n_nationkey")).repartition(parts, key)
                .select(F.col(key).alias("row_id"), F.to_json(payload).alias("raw_payload")))

    def raw_profiles(self) -> DataFrame:
        """Source-A raw payloads as JSON text (one per customer)."""
        key, bal = F.col("c_custkey").cast("string"), F.col("c_acctbal")
        social = "array<struct<type:string,content:string>>"
        socials = F.concat(
            F.when(bal > 7000, F.array(F.struct(F.lit("GitHub").alias("type"), F.concat(
                F.lit("https://github.com/supp"), key).alias("content")))).otherwise(F.array().cast(social)),
            F.array(F.struct(F.lit("Website").alias("type"),
                             F.concat(F.lit("https://site.example/"), key).alias("content"))))
        grid = F.when(F.col("c_nationkey") < 5, F.array(F.struct(F.struct(F.struct(
            F.lit("jike").alias("type"), F.concat(F.lit(" jk"), key, F.lit(" ")).alias("content")).alias("social"))
            .alias("content"))))
        creations = F.when(bal > 3000, F.array(F.struct(
            F.concat(F.lit("https://made.example/"), key).alias("url"),
            F.concat(F.lit(" Thing "), key).alias("title"), F.col("c_mktsegment").alias("description"))))
        payload = F.struct(
            F.concat(F.lit("a"), key).alias("_id"), F.concat(F.lit("cust"), key).alias("profile_link"),
            F.when(bal > 5000, F.concat(F.lit("/member-"), key)).alias("user_link"),
            F.concat(F.lit("Member "), F.substring("c_name", 10, 9)).alias("name"),
            F.when(bal >= 0, F.concat(F.lower("c_mktsegment"), F.lit(" builder at github.com/fan"), key)).alias("bio"),
            F.concat(F.lit("in "), F.col("n_name"), F.lit(", "), F.col("r_name")).alias("description"),
            F.lit("2020-01-01T00:00:00Z").alias("update_time"), socials.alias("socials"), grid.alias("gridItems"),
            creations.alias("creations"),
            F.struct(F.struct(F.col("r_name").alias("countryName"), F.col("n_name").alias("cityName")).alias("region"),
                     F.when(F.col("c_mktsegment") == "MACHINERY", "engineer | founder").alias("role"),
                     F.concat(F.lit("building "), F.col("c_mktsegment")).alias("current_doing")).alias("basicInfo"))
        return self._payloads("customer", "c_custkey", "c_nationkey", payload)

    def raw_code_profiles(self) -> DataFrame:
        """Source-B raw payloads as JSON text (one per supplier)."""
        key, bal = F.col("s_suppkey").cast("string"), F.col("s_acctbal")
        payload = F.struct(
            F.col("s_suppkey").alias("id"), F.concat(F.lit("supp"), key).alias("login"),
            F.concat(F.lit("https://github.com/supp"), key).alias("html_url"),
            F.concat(F.lit("Member "), F.substring("s_name", 10, 9)).alias("name"), F.col("n_name").alias("company"),
            F.when(bal > 5000, F.concat(F.lit(" https://blog.example/"), key)).alias("blog"),
            F.concat_ws(" / ", "r_name", "n_name").alias("location"),
            F.when(bal > 2000, F.concat(F.lit("engineer in "), F.col("n_name"))).alias("bio"),
            F.when(bal > 6000, F.concat(F.lit("tw"), key)).alias("twitter_username"),
            F.lit(3).alias("public_repos"), F.floor("s_acctbal").alias("followers"),
            F.lit("2020-01-01T00:00:00Z").alias("updated_at"))
        return self._payloads("supplier", "s_suppkey", "s_nationkey", payload)

    def identities(self) -> DataFrame:
        c = self.raw("customer").filter("c_acctbal >= 1000").select(
            F.col("c_custkey").alias("person_id"), F.concat(F.lit("a"), F.col("c_custkey")).alias("profile_id"),
            F.lit(1.0).alias("match_score"), F.lit(True).alias("is_primary"))
        s = self.raw("supplier").filter("s_acctbal >= 3000").select(
            F.col("s_suppkey").alias("person_id"), F.concat(F.lit("b"), F.col("s_suppkey")).alias("profile_id"),
            F.lit(0.9).alias("match_score"), F.lit(False).alias("is_primary"))
        return c.unionByName(s)

    def profiles(self) -> DataFrame:
        """Flat stored profiles of both sources (already normalised)."""
        c = (self.raw("customer").join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.concat(F.lit("a"), F.col("c_custkey")).alias("profile_id"), F.lit("bonjour").alias("source"),
                     F.concat(F.lit("cust"), F.col("c_custkey")).alias("handle"),
                     F.concat(F.lit("https://bonjour.bio/cust"), F.col("c_custkey")).alias("url"),
                     F.concat(F.lit("Member "), F.substring("c_name", 10, 9)).alias("display_name"),
                     F.when(F.col("c_mktsegment") == "MACHINERY", "engineer").alias("headline"),
                     F.concat(F.lit("in "), F.lower("n_name"), F.lit(".")).alias("bio"),
                     F.concat_ws(" / ", "r_name", "n_name").alias("location"),
                     F.when(F.col("c_acctbal") > 9900, F.concat(F.lit("supp"), F.col("c_custkey"))).alias("link_handle"),
                     F.lower("n_name").alias("company"), (F.col("c_acctbal") < -900).alias("is_deleted"),
                     F.expr("timestamp'2001-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(c_custkey as int))")
                     .alias("synced_at"), F.col("c_custkey").alias("ordinal")))
        s = (self.raw("supplier").join(self.places(), F.col("s_nationkey") == F.col("n_nationkey"))
             .select(F.concat(F.lit("b"), F.col("s_suppkey")).alias("profile_id"), F.lit("github").alias("source"),
                     F.concat(F.lit("supp"), F.col("s_suppkey")).alias("handle"),
                     F.concat(F.lit("https://github.com/supp"), F.col("s_suppkey")).alias("url"),
                     F.concat(F.lit("Member "), F.substring("s_name", 10, 9)).alias("display_name"),
                     F.when(F.col("s_acctbal") > 2000, "engineer").alias("headline"),
                     F.concat(F.lit("works in "), F.lower("n_name"), F.lit(".")).alias("bio"),
                     F.concat_ws(" / ", "r_name", "n_name").alias("location"),
                     F.lit(None).cast("string").alias("link_handle"), F.lower("n_name").alias("company"),
                     (F.col("s_acctbal") < -700).alias("is_deleted"),
                     F.expr("timestamp'2001-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(s_suppkey as int))")
                     .alias("synced_at"), F.col("s_suppkey").alias("ordinal")))
        return c.unionByName(s)

    def opt_outs(self) -> DataFrame:
        bal = F.col("s_acctbal")
        s = self.raw("supplier").filter("s_acctbal < 500").select(
            F.concat(F.lit("o"), F.col("s_suppkey")).alias("request_id"), F.lit("github").alias("source"),
            F.concat(F.lit("supp"), F.col("s_suppkey")).alias("handle"),
            F.when(bal < 200, "processed").otherwise("pending").alias("status"))
        c = self.raw("customer").filter("c_acctbal < -500").select(
            F.concat(F.lit("p"), F.col("c_custkey")).alias("request_id"), F.lit("bonjour").alias("source"),
            F.concat(F.lit("cust"), F.col("c_custkey")).alias("handle"), F.lit("processed").alias("status"))
        return s.unionByName(c)

    def links(self) -> DataFrame:
        """Directed sightings: a supplier's page lists a customer ('friend') or the reverse ('friended')."""
        return (self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.concat(F.lit("supp"), F.col("l_suppkey")).alias("src"),
                        F.concat(F.lit("cust"), F.col("o_custkey")).alias("dst"),
                        F.when(F.col("l_linestatus") == "O", "friend").otherwise("friended").alias("edge_type"),
                        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Name "), F.col("o_custkey"))).alias("name"),
                        F.when(F.col("l_returnflag") != "N", F.concat_ws(" ", "l_shipdate", "o_orderpriority"))
                        .alias("description"),
                        F.concat(F.lit("f"), F.col("l_suppkey"), F.lit(".json")).alias("file"),
                        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber",
                                    "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("seen_order")))

    def post_refs(self) -> DataFrame:
        """Post -> profile reference rows (post = order, reference = supplier of a line)."""
        return (self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("o_orderkey").alias("post_id"), F.lower("o_orderpriority").alias("category"),
                        F.col("o_orderpriority").alias("category_title"),
                        F.concat_ws(" ", "o_orderpriority", "l_shipdate").alias("content"),
                        F.concat(F.lit("supp"), F.col("l_suppkey")).alias("handle"),
                        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("S"), F.col("l_suppkey"))).alias("name"),
                        F.when(F.col("l_returnflag") == "R", F.lower("l_linestatus")).alias("description"),
                        F.when(F.col("l_linenumber") <= 2, "category").when(F.col("l_linenumber") <= 4, "post_like")
                        .when(F.col("l_linenumber") <= 6, "post_comment").otherwise("external_import")
                        .alias("source_kind"), F.col("l_partkey").alias("part"),
                        F.col("l_quantity").alias("weight")))

    def alias_rows(self) -> DataFrame:
        """(person, alias) rows; a full-quantity line is an explicit alias with confidence 1."""
        return (self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("o_custkey").alias("person_id"),
                        F.when(F.col("l_returnflag") == "A", "github").when(F.col("l_returnflag") == "N", "x")
                        .otherwise("jike").alias("alias_type"),
                        F.concat(F.lit("@P"), F.col("l_partkey")).alias("alias_value"),
                        F.when(F.col("l_quantity") >= 50, 1.0).otherwise(0.8).alias("confidence")))


# --- the same relations in SQL ---------------------------------------------------------
_cte("places", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
_cte("persons", """
  SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS headline,
    CASE WHEN c_acctbal >= 0 THEN 'account in ' || r_name END AS summary,
    r_name || ' / ' || n_name AS location,
    CASE WHEN c_acctbal < 0 THEN 'hidden' WHEN c_acctbal > 9000 THEN 'claimed' ELSE 'active' END AS status,
    greatest(c_acctbal, 0.0) / 10000 AS confidence,
    coalesce(first_at, TIMESTAMP '1995-01-01 00:00:00') AS created_at,
    coalesce(last_at, TIMESTAMP '1995-01-01 00:00:00') AS updated_at
  FROM customer JOIN places ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1) o
    ON o.o_custkey = c_custkey""", ["places"])
_cte("evidence", """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT)
      AS evidence_id, o_custkey AS person_id,
    CASE l_returnflag WHEN 'A' THEN 'bonjour' WHEN 'N' THEN 'github' ELSE 'web' END AS source,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'project' WHEN '2-HIGH' THEN 'repository' WHEN '3-MEDIUM' THEN 'experience'
      WHEN '5-LOW' THEN 'profile_field' ELSE 'job_signal' END AS evidence_type,
    p_name AS title, lower(p_type) AS description,
    CASE WHEN l_linestatus = 'O' THEN 'https://made.example/p/' || p_partkey END AS url,
    o_orderdate AS occurred_at, l_shipdate AS created_at, lower(p_brand) AS language,
    CASE WHEN p_size < 25 THEN 'role' ELSE 'location' END AS field, l_quantity AS followers
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")
_cte("search_docs", f"""
  SELECT d.doc_id AS person_id, regexp_extract(text, '^(\\S+ \\S+)', 1) AS name,
    source || ' writer in ' || lang AS headline, lang AS location, text AS doc_text,
    ['writer', lang] AS facet_role, [lang, 'lang / ' || lang] AS facet_location,
    CASE WHEN source IN ('src0','src1','src2','src3') THEN [source, 'github']
         WHEN source IN ('src3','src4','src5') THEN [source, 'bonjour'] ELSE [source] END AS facet_source,
    list_filter([{', '.join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in TAG_WORDS)}],
      lambda x: x IS NOT NULL) AS facet_tags,
    CASE WHEN toxic = 1 THEN 'hidden' WHEN quality = 0 THEN 'claimed' ELSE 'active' END AS status,
    CAST(floor(n_chars / 50) AS INT) AS freshness,
    TIMESTAMP '{DOC_BASE}' + to_seconds(n_chars) AS updated_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
_cte("doc_embeddings", f"""
  SELECT vec_id AS person_id, embedding, label,
    TIMESTAMP '{DOC_BASE}' + to_seconds(2000 + label * 100) AS embedded_at FROM embeddings""")
_cte("queries", """
  SELECT item_id AS query_id, text AS raw_query,
    CASE WHEN length(text) % 2 = 0 THEN ['writer'] ELSE [] END AS roles,
    [lower(regexp_extract(text, '^([^\\s.,]+)', 1)), CASE length(text) % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' ELSE 'gear' END] AS skills,
    CASE WHEN length(text) % 7 = 0 THEN ['en'] ELSE [] END AS locations,
    CASE WHEN length(text) % 5 = 0 THEN ['of the'] ELSE [] END AS must_haves,
    CAST([] AS VARCHAR[]) AS nice_to_haves,
    CASE WHEN length(text) % 6 = 0 THEN 'github' END AS source_bias FROM benchmark""")
_cte("query_vectors", "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id")
_cte("viewer_events", """
  SELECT event_id, user_id AS viewer_id, k AS person_id,
    CASE event_type WHEN 'view' THEN 'detail_view' WHEN 'click' THEN 'evidence_expand' WHEN 'purchase' THEN 'contacted'
      WHEN 'signup' THEN 'interested' ELSE 'not_interested' END AS kind,
    CASE WHEN k < 30 THEN ['ai_agents', 'open_source'] WHEN k < 60 THEN ['robotics'] ELSE CAST([] AS VARCHAR[]) END AS tags,
    ts, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
_cte("all_viewer_events", """
  SELECT event_id, viewer_id, person_id, kind, tags, ts FROM viewer_events
  UNION ALL SELECT event_id, viewer_id, person_id, 'surfaced', CAST([] AS VARCHAR[]), ts FROM viewer_events
  WHERE value > 100""", ["viewer_events"])
_cte("feedback", """
  SELECT event_id AS feedback_id, user_id, k AS person_id,
    CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('purchase', 'signup') THEN 'positive'
      ELSE 'neutral' END AS sentiment,
    CASE WHEN k < 20 THEN 'skill_mismatch' WHEN k < 40 THEN 'location_mismatch' WHEN k < 60 THEN 'experience_mismatch'
      WHEN k < 80 THEN 'not_active' END AS reason_code, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
_cte("memories", """
  SELECT event_id AS memory_id, user_id,
    CASE event_type WHEN 'view' THEN 'preference' WHEN 'click' THEN 'feedback' WHEN 'purchase' THEN 'hiring_context'
      ELSE 'preference' END AS kind,
    CASE WHEN k < 50 THEN 'global' ELSE 'role' END AS scope_kind,
    CASE WHEN k >= 50 THEN 'role' || (k % 5) END AS scope_value,
    ['tech' || (k % 7)] AS tech_stack, CASE WHEN k % 3 = 0 THEN ['city' || (k % 4)] END AS locations,
    CASE WHEN k % 4 = 0 THEN 'role' || (k % 5) END AS role,
    CASE WHEN k < 10 THEN 'avoidInactive' END AS preference_key,
    CASE WHEN value > 20 THEN 'inferred' ELSE 'explicit' END AS source, ts AS updated_at,
    CASE WHEN value > 20 THEN ts + INTERVAL 10 DAY END AS expires_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
_cte("claims", """
  SELECT o_orderkey AS claim_id, o_custkey AS person_id,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'email' ELSE 'github' END AS method,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'revoked' END AS status,
    o_orderdate AS submitted_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS verified_at
  FROM orders""")
_cte("identities", """
  SELECT c_custkey AS person_id, 'a' || c_custkey AS profile_id, 1.0::DOUBLE AS match_score, TRUE AS is_primary
  FROM customer WHERE c_acctbal >= 1000
  UNION ALL SELECT s_suppkey, 'b' || s_suppkey, 0.9::DOUBLE, FALSE FROM supplier WHERE s_acctbal >= 3000""")
_cte("profiles", """
  SELECT 'a' || c_custkey AS profile_id, 'bonjour' AS source, 'cust' || c_custkey AS handle,
    'https://bonjour.bio/cust' || c_custkey AS url, 'Member ' || substr(c_name, 10, 9) AS display_name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'engineer' END AS headline, 'in ' || lower(n_name) || '.' AS bio,
    r_name || ' / ' || n_name AS location, CASE WHEN c_acctbal > 9900 THEN 'supp' || c_custkey END AS link_handle,
    lower(n_name) AS company, c_acctbal < -900 AS is_deleted,
    TIMESTAMP '2001-01-01 00:00:00' + to_minutes(c_custkey) AS synced_at, c_custkey AS ordinal
  FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'b' || s_suppkey, 'github', 'supp' || s_suppkey, 'https://github.com/supp' || s_suppkey,
    'Member ' || substr(s_name, 10, 9), CASE WHEN s_acctbal > 2000 THEN 'engineer' END,
    'works in ' || lower(n_name) || '.', r_name || ' / ' || n_name, NULL, lower(n_name), s_acctbal < -700,
    TIMESTAMP '2001-01-01 00:00:00' + to_minutes(s_suppkey), s_suppkey
  FROM supplier JOIN places ON s_nationkey = n_nationkey""", ["places"])
_cte("opt_outs", """
  SELECT 'o' || s_suppkey AS request_id, 'github' AS source, 'supp' || s_suppkey AS handle,
    CASE WHEN s_acctbal < 200 THEN 'processed' ELSE 'pending' END AS status FROM supplier WHERE s_acctbal < 500
  UNION ALL SELECT 'p' || c_custkey, 'bonjour', 'cust' || c_custkey, 'processed' FROM customer WHERE c_acctbal < -500""")
_cte("links", """
  SELECT 'supp' || l_suppkey AS src, 'cust' || o_custkey AS dst,
    CASE WHEN l_linestatus = 'O' THEN 'friend' ELSE 'friended' END AS edge_type,
    CASE WHEN l_returnflag = 'A' THEN 'Name ' || o_custkey END AS name,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS VARCHAR) || ' ' || o_orderpriority END AS description,
    'f' || l_suppkey || '.json' AS file,
    lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || CAST(l_quantity AS INT) AS seen_order
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
_cte("post_refs", """
  SELECT o_orderkey AS post_id, lower(o_orderpriority) AS category, o_orderpriority AS category_title,
    o_orderpriority || ' ' || CAST(l_shipdate AS VARCHAR) AS content, 'supp' || l_suppkey AS handle,
    CASE WHEN l_returnflag = 'A' THEN 'S' || l_suppkey END AS name,
    CASE WHEN l_returnflag = 'R' THEN lower(l_linestatus) END AS description,
    CASE WHEN l_linenumber <= 2 THEN 'category' WHEN l_linenumber <= 4 THEN 'post_like'
      WHEN l_linenumber <= 6 THEN 'post_comment' ELSE 'external_import' END AS source_kind, l_partkey AS part,
    l_quantity AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
_cte("alias_rows", """
  SELECT o_custkey AS person_id, CASE l_returnflag WHEN 'A' THEN 'github' WHEN 'N' THEN 'x' ELSE 'jike' END AS alias_type,
    '@P' || l_partkey AS alias_value, CASE WHEN l_quantity >= 50 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
