import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peopleweave.functions import arrays, dates, similarity, text, udfs
from peopleweave.operators import dedupe, filters, goals, index, normalize, retrieve


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    rows = [tuple(v for _, v in values.values())] if values else [(1,)]
    return spark.createDataFrame(rows, schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,expected", [
    ("浙大 RAG", "zhejiang university rag"), ("ZJU，校友", "zhejiang university 校友"), ("ＡＩ　Infra!!", "ai infra"), ("a-b_c", "a b c"),
    ("  ", ""), ("zjux", "zjux")])
def test_search_text(spark, raw, expected):
    assert one(spark, text.normalize_search_text("t"), t=("string", raw)) == expected


@pytest.mark.parametrize("term,context,hit", [
    ("rag", "智能rag体", True), ("rag", "dragon", False), ("Next.js", "uses next.js daily", True), ("open  source", "some open source work", True),
    ("c++", "knows c++ well", True), ("后端", "做后端开发", True), ("", "anything", False), ("go", "golang", False)])
def test_context_term(spark, term, context, hit):
    assert one(spark, text.context_term_match(F.col("t"), F.col("c")), t=("string", term), c=("string", context)) is hit


def test_headline_clamp(spark):
    clamp = text.clamp_headline("t")
    assert one(spark, clamp, t=("string", "  a \t b\nsecond")) == "a b"
    assert one(spark, clamp, t=("string", "x" * 60)) == "x" * 60
    assert one(spark, clamp, t=("string", "智" * 61)) == "智" * 57 + "..."
    assert one(spark, clamp, t=("string", " \n ")) is None


@pytest.mark.parametrize("score,reasons,expected", [
    (0.9, [], "weak"), (float("nan"), ["技术命中：x", "project: y"], "strong"), (float("inf"), ["role match: a"], "medium"), (56.0, ["role match: a"], "strong"),
    (0.45, ["地点命中：x", "近期活跃：y"], "medium"), (0.7, ["whatever"], "medium"), (-3.0, ["role match: fallback"], "weak")])
def test_match_strength(spark, score, reasons, expected):
    assert one(spark, similarity.match_strength("s", "r"), s=("double", score), r=("array<string>", reasons)) == expected



def test_field_and_headline_agree_with_the_patterns(spark):
    edges = ["", " ", "\t", "\r", "\r\n", "\n", "\u00a0", "\u3000", "\u0085", "\u2028", "\u200b", "/", "a", "b  c", "x" * 61]
    rows = [(a + b + c, c + a) for a in edges for b in edges for c in edges] + [(None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    field, chain = text.field_or_null(F.col("a")), text.headline_chain(F.col("a"), F.col("b"))
    apart = df.filter(~field.eqNullSafe(text.blank_to_null("a")) | ~chain.eqNullSafe(F.coalesce(text.clamp_headline("a"), text.clamp_headline("b"))))
    assert df.count() == len(edges) ** 3 + 2 and apart.count() == 0


def test_cosine_edges(spark):
    cos = similarity.cosine("a", "b")
    assert one(spark, cos, a=("array<float>", [1.0, 0.0]), b=("array<float>", [1.0])) == 0.0
    assert one(spark, cos, a=("array<float>", []), b=("array<float>", [])) == 0.0
    assert one(spark, cos, a=("array<float>", [0.0, 0.0]), b=("array<float>", [1.0, 1.0])) == 0.0
    assert math.isclose(one(spark, cos, a=("array<float>", [1.0, 2.0]), b=("array<float>", [2.0, 4.0])), 1.0)


def test_clamp_and_percent(spark):
    for value, clamped, pct in ((float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0), (1.5, 1.0, 1.5), (-1.0, 0.0, 0.0), (0.5, 0.5, 50.0), (None, 0.0, 0.0)):
        assert one(spark, similarity.clamp01(F.col("v")), v=("double", value)) == clamped
        assert one(spark, similarity.percent("v"), v=("double", value)) == pct


def test_dates(spark):
    now = "2024-05-10 00:00:00"
    label = dates.relative_label(F.col("t").cast("timestamp"), now)
    for value, expected in (("2024-05-11", "今天"), ("2024-05-09", "昨天"), ("2024-05-03", "7天前"), ("2024-04-20", "2周前"), ("2024-01-01", "4个月前"),
                            ("2022-01-01", "2年前"), (None, None)):
        assert one(spark, label, t=("string", value)) == expected
    assert one(spark, dates.age_days(F.col("t").cast("timestamp"), now), t=("string", "2025-01-01")) == 0
    assert one(spark, dates.age_days(F.col("t").cast("timestamp"), now), t=("string", None)) is None


def test_arrays(spark):
    assert one(spark, arrays.dedupe_keep_first("a"), a=("array<string>", ["B", " b", "", "a", "A "])) == ["B", "a"]
    assert one(spark, arrays.dedupe_keep_first("a"), a=("array<string>", None)) == []
    assert one(spark, arrays.count_by("a"), a=("array<string>", ["x", "y", "x"])) == {"x": 2, "y": 1}
    fam = {"ml": ["Machine Learning"], "ai": ["ml", "智能"]}
    assert one(spark, arrays.expand_family("a", fam), a=("array<string>", ["ML", "other"])) == ["ml", "machine learning", "ai", "智能", "other"]


def test_json_repair(spark):
    fixed = text.coerce_json("t")
    assert one(spark, fixed, t=("string", '{"a":1}')) == '{"a":1}'
    assert one(spark, fixed, t=("string", '"{\\"a\\":1}"')) == '{"a":1}'
    assert one(spark, fixed, t=("string", '"\\"{\\\\\\"a\\\\\\":1}\\""')) == '{"a":1}'
    for broken in ("not json", "[1]", '"text"', "", None):
        assert one(spark, fixed, t=("string", broken)) is None


@pytest.mark.parametrize("url,identity,key", [
    ("https://Site.example/a/b/?q=1#x", "site.example:" + __import__("hashlib").md5(b"/a/b").hexdigest()[:8], "https://site.example/a/b?q=1"),
    ("http://x.example", "x.example", "http://x.example/"), ("http://x.example/", "x.example", "http://x.example/"), ("Not A Url/", None, "not a url")])
def test_urls(spark, url, identity, key):
    assert one(spark, text.url_identity("u"), u=("string", url)) == identity
    assert one(spark, text.url_key("u"), u=("string", url)) == key


def test_html(spark):
    page = "<HEAD><STYLE>x</STYLE></HEAD><nav>menu</nav><p>Hello<br>there</p><script>\nvar a;\n</script>"
    assert one(spark, text.html_to_text("h"), h=("string", page)) == "Hello there"


@pytest.mark.parametrize("kind,value,expected", [
    ("github", "https://github.com/Some-One/repo", "some-one"), ("github", "@Some", "some"), ("github", "github.com/@abc?x=1", "abc"), ("github", "a/b", None),
    ("x", "twitter.com/User_1", "user_1"), ("x", "https://x.com/abc/status/1", "abc"), ("x", "waytoolongforahandle", None), ("jike", " @Jk ", "jk"),
    ("jike", "  ", None), ("website", "https://a.example", None)])
def test_strong_alias(spark, kind, value, expected):
    assert one(spark, dedupe.canonical_alias(F.col("k"), F.col("v")), k=("string", kind), v=("string", value)) == expected


@pytest.mark.parametrize("segment,labels", [
    ("Co-founder & CEO", ["联合创始人"]), ("AI engineer", ["AI工程师"]), ("full-stack engineer", ["全栈工程师"]), ("LLM researcher", ["AI研究员"]),
    ("We are hiring engineers", []), ("indie hacker", ["独立开发者"]), ("VC partner", ["合伙人", "投资人"]), ("Product Manager growth", ["产品经理"]),
    ("x" * 40, []), ("增长", ["运营"])])
def test_role_labels(spark, segment, labels):
    assert one(spark, index.role_labels(F.col("s")), s=("string", segment)) == labels


def test_role_segments(spark):
    assert one(spark, text.role_segments("s"), s=("string", "• CTO at Acme；前端，「x」 / Founder@Shop [old]")) == ["CTO", "前端", "「x」", "Founder"]


def test_direction_tags(spark):
    assert one(spark, goals.tags_of(F.col("t")), t=("string", "Agents for open source robots 机器人")) == ["ai_agents", "open_source", "robotics"]


def test_place_names(spark):
    assert one(spark, index.place_names(F.col("l")), l=("string", "中国 / 浙江省 / 杭州市")) == ["中国 / 浙江省 / 杭州市", "中国", "浙江省", "杭州市", "浙江", "杭州"]


def test_must_have_drops_weak_terms(spark):
    got = one(spark, filters.usable_must_haves(F.col("t")), t=("array<string>", ["GitHub profile", "recently active", "go", "RAG", "machine learning", "后端", " "]))
    assert got == ["rag", "machine learning", "后端"]


def test_profile_aliases_first_wins(spark):
    raw = ('{"_id":"1","profile_link":"h","name":"N","bio":"see github.com/abc and @xyz x.com/Who","socials":[{"type":"GitHub","content":"https://github.com/ABC"},'
           '{"type":null,"content":"z"},{"type":"Mail","content":" m "}],"gridItems":[{"content":{"social":{"type":"X","content":"https://x.com/who"}}}]}')
    row = normalize.normalize_profiles(spark.createDataFrame([(raw,)], "raw_payload string")).first()
    assert [(a["type"], a["value"], a["confidence"]) for a in row["aliases"]] == [("github", "ABC", 1.0), ("other", "m", 1.0), ("x", "who", 1.0), ("github", "xyz", 0.8)]


def test_disambiguation_needs_a_shared_name(spark):
    rows = [("q", "find Li Wei", str(i), i, n, h, [], ["github"]) for i, (n, h) in enumerate([("Li Wei", "Designer"), ("li  wei", "Engineer"), ("Wang", "x")])]
    df = spark.createDataFrame(rows, "query_id string, raw_query string, person_id string, rank int, name string, headline string, reasons array<string>, facet_source array<string>")
    notes = {r["person_id"]: r["note"] for r in retrieve.disambiguation_notes(df).collect()}
    assert set(notes) == {"0", "1"} and "当前是 Designer；其他还有 Engineer" in notes["0"]


def reference_trigrams(value):
    import re
    out = set()
    for w in re.findall(r"[^\W_]+", value.lower()):
        p = f"  {w} "
        out |= {p[i:i + 3] for i in range(len(p) - 2)}
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abcé智能 -_!12\n", max_size=25), min_size=1, max_size=40))
def test_trigrams_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", similarity.trigrams("t").alias("g"))
    for r in df.collect():
        assert set(r["g"]) == reference_trigrams(r["t"]) and len(set(r["g"])) == len(r["g"])


def test_embedder_and_scorer(spark):
    docs = spark.createDataFrame([(1, "hello", "2024-01-01"), (2, None, "2024-01-01")], "person_id int, doc_text string, u string").withColumn("updated_at", F.col("u").cast("timestamp"))
    made = {r["person_id"]: r for r in udfs.embed_documents(docs).collect()}
    assert made[1]["dimension"] == 64 and len(made) == 2
    pairs = spark.createDataFrame([(1, 1, "a b", "b c"), (1, 2, "", "x")], "query_id int, person_id int, intent_text string, candidate_text string")
    got = udfs.score_pairs(pairs).collect()
    assert [(r["person_id"], r["pair_score"]) for r in got] == [(1, 0.5)]  # no words: left out, not zero


def test_hashed_embedder_hashes_each_trigram_of_a_text_once(monkeypatch):
    import hashlib
    from peopleweave.functions import udfs

    monkeypatch.setattr(udfs, "lru_cache", lambda size: lambda f: f)
    calls = []
    plain = hashlib.blake2b
    monkeypatch.setattr(udfs.hashlib, "blake2b", lambda data, digest_size: calls.append(data) or plain(data, digest_size=digest_size))
    text = "ab日😀" * 50
    got = udfs.hashed_embedder(16)([text, ""])
    assert len(calls) == len({f"  {text} "[i:i + 3] for i in range(len(text) + 1)}) + 1
    want = [0.0] * 16
    for i in range(len(text) + 1):
        h = int.from_bytes(plain(f"  {text} "[i:i + 3].encode(), digest_size=8).digest(), "little")
        want[h % 16] += 1.0 if h >> 63 else -1.0
    length = sum(x * x for x in want) ** 0.5
    assert max(abs(a - b / length) for a, b in zip(got[0].tolist(), want)) < 1e-6
