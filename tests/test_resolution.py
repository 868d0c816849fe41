"""Identity and de-duplication against small sequential models."""
import random

import pytest
from peopleweave.operators import dedupe, graph, identity

SCHEMA = "profile_id string, handle string, display_name string, location string, headline string, bio string, companies array<string>, linked_handles array<string>, ordinal long"


def score(a, b):
    name = loc = org = 0.0
    if a["display_name"] and b["display_name"]:
        x, y = a["display_name"].lower().strip(), b["display_name"].lower().strip()
        name = 0.5 if x == y else 0.4 if x.replace(" ", "") == y.replace(" ", "") else 0.25 if x in y or y in x else 0.0
    if a["location"] and b["location"]:
        x, y = a["location"].lower().strip(), b["location"].lower().strip()
        if x == y:
            loc = 0.3
        else:
            import re
            ta, tb = ([t for t in re.split(r"\s*[,/]\s*|\s+", v) if t] for v in (x, y))
            n = len([t for t in ta if t in tb])
            loc = 0.2 if n >= 2 else 0.1 if n == 1 else 0.0
    ta, tb = (f"{p['headline'] or ''} {p['bio'] or ''}".lower() for p in (a, b))
    if any(c.lower() in tb for c in a["companies"]) or any(c.lower() in ta for c in b["companies"]):
        org = 0.2
    elif any(k in ta and k in tb for k in ("founder", "engineer", "developer", "designer", "product")):
        org = 0.1
    return min(1.0, name + loc + org)


def walk(lefts, rights, owner):
    taken, matches, conflicts, review = set(), {}, {}, set()
    for a in lefts:
        best, top = None, 0.0
        for b in rights:
            if b["profile_id"] in taken:
                continue
            s = 1.0 if b["handle"].lower() in [h.lower() for h in a["linked_handles"]] else score(a, b)
            if s > top:
                best, top = b, s
        if best is not None and top >= 0.9:
            pa, pb = owner.get(a["profile_id"]), owner.get(best["profile_id"])
            if pa is not None and pb is not None and pa != pb:
                conflicts[a["profile_id"]] = best["profile_id"]
                continue
            matches[a["profile_id"]] = best["profile_id"]
            taken.add(best["profile_id"])
        elif best is not None and top >= 0.7:
            review.add(a["profile_id"])
    return matches, conflicts, review


def profiles(rng, side, n):
    names = ["Li Wei", "LiWei", "Li  Wei", "Wei", "Ann Lee", "ann lee", None, "Bo"]
    places = ["China / Hangzhou", "China / Beijing", "hangzhou", None, "China Hangzhou"]
    out = []
    for i in range(n):
        out.append({"profile_id": f"{side}{i}", "handle": f"{side}h{i}", "display_name": rng.choice(names), "location": rng.choice(places),
                    "headline": rng.choice(["engineer", "founder of Acme", None]), "bio": rng.choice(["at acme labs", "designer", None]),
                    "companies": rng.choice([[], ["Acme"], ["Labs"]]), "linked_handles": [f"rh{rng.randrange(n)}"] if side == "l" and rng.random() < 0.15 else [],
                    "ordinal": i})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("profile_id", "handle", "display_name", "location", "headline", "bio", "companies", "linked_handles", "ordinal")) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_equals_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    lefts, rights = profiles(rng, "l", 25), profiles(rng, "r", 20)
    owner = {p["profile_id"]: rng.choice(["p1", "p2", "p3"]) for p in rng.sample(lefts + rights, 14)}
    ids = spark.createDataFrame(list(owner.items()), "profile_id string, person_id string")
    out = identity.resolve(frame(spark, lefts), frame(spark, rights), ids)
    matches, conflicts, review = walk(lefts, rights, owner)
    assert {r["left_id"]: r["right_id"] for r in out["matches"].collect()} == matches
    assert {r["left_id"]: r["right_id"] for r in out["conflicts"].collect()} == conflicts
    assert {r["left_id"] for r in out["review"].collect()} == review
    linked = set(matches) | set(matches.values()) | set(owner)
    assert {r["profile_id"] for r in out["singletons"].collect()} == {p["profile_id"] for p in lefts + rights} - linked


def test_many_copies_of_one_profile_pair_in_order(spark):
    base = {"display_name": "Same Name", "location": "X / Y", "headline": "engineer", "bio": "acme", "companies": ["acme"], "linked_handles": []}
    lefts = [{**base, "profile_id": f"l{i}", "handle": f"lh{i}", "ordinal": i} for i in range(300)]
    rights = [{**base, "profile_id": f"r{i}", "handle": f"rh{i}", "ordinal": i} for i in range(200)]
    none = spark.createDataFrame([], "profile_id string, person_id string")
    out = identity.resolve(frame(spark, lefts), frame(spark, rights), none, max_rounds=3)
    assert {(r["left_id"], r["right_id"]) for r in out["matches"].collect()} == {(f"l{i}", f"r{i}") for i in range(200)}


def test_ten_thousand_contenders_of_several_groups_settle_in_few_rounds(spark):
    """Profiles of many groups that all want the same rights, some of them with a person already."""
    n, m = 6_000, 4_000
    base = ["'Same Name' AS display_name", "'X / Y' AS location", "'engineer' AS headline", "array('acme') AS companies", "array_except(array('x'), array('x')) AS linked_handles", "id AS ordinal"]
    lefts = spark.range(n).selectExpr("concat('l', id) AS profile_id", "concat('lh', id) AS handle", "concat('acme ', id % 50) AS bio", *base)
    rights = spark.range(m).selectExpr("concat('r', id) AS profile_id", "concat('rh', id) AS handle", "'acme' AS bio", *base)
    ids = spark.createDataFrame([("l5", "p5"), ("l900", "p9")], "profile_id string, person_id string")
    out = identity.resolve(lefts, rights, ids, max_rounds=20)
    assert {(r["left_id"], r["right_id"]) for r in out["matches"].collect()} == {(f"l{i}", f"r{i}") for i in range(m)}


def components_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_star_edges_give_the_components_of_all_pairs(spark):
    rng = random.Random(7)
    people = [(i, rng.choice(["ann lee", "ann", "Bob", "bo b", "bob x", None, "zed"]), rng.choice(["P", "p ", "Q", None])) for i in range(80)]
    rows = [(rng.randrange(80), f"github:g{rng.randrange(25)}", "github") for _ in range(120)]
    p = spark.createDataFrame(people, "person_id int, name string, location string")
    a = spark.createDataFrame(rows, "person_id int, alias_key string, alias_type string").distinct()
    by = {i: (n, l) for i, n, l in people}

    def linked(x, y):
        (n1, l1), (n2, l2) = by[x], by[y]
        if l1 and l2 and l1.lower().strip() == l2.lower().strip():
            return True
        if not n1 or not n2:
            return False
        m1, m2 = n1.lower().strip(), n2.lower().strip()
        return m1.replace(" ", "") == m2.replace(" ", "") or m1 in m2 or m2 in m1

    groups = {}
    for person, key, _ in set(rows):
        groups.setdefault(key, set()).add(person)
    pairs = [(x, y) for g in groups.values() for x in g for y in g if x < y and linked(x, y)]
    nodes = {n for pair in pairs for n in pair}
    got = {r["node"]: r["component"] for r in dedupe.connected_components(dedupe.alias_edges(a, p)).collect()}
    assert got == components_of(nodes, pairs)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    hub = [(5000, i) for i in range(5001, 6500)]
    got = {r["node"]: r["component"] for r in dedupe.connected_components(spark.createDataFrame(path + hub, "src int, dst int"), max_rounds=15).collect()}
    assert {got[n] for n in range(100, 401)} == {100} and {got[n] for n in range(5000, 6500)} == {5000}


def test_merge_drops_losers_and_moves_identities(spark):
    w = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "person_id int, component int, winner int")
    people = spark.createDataFrame([(1,), (2,), (3,)], "person_id int")
    ids = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0)], "person_id int, profile_id string, match_score double")
    out = dedupe.merge_persons(w, people, ids, people, people)
    assert {(r["profile_id"], r["person_id"]) for r in out["identities"].collect()} == {("a", 1), ("b", 1), ("c", 3)}
    assert {r[0] for r in out["persons"].collect()} == {1, 3} and {r[0] for r in out["docs"].collect()} == {3}


def test_crawl_budget_and_depth(spark):
    edges = spark.createDataFrame([("s", x) for x in "abc"] + [("a", "d"), ("b", "d"), ("c", "e"), ("d", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("s",)], "handle string")
    got = {r["handle"]: (r["first_depth"], r["incoming"], r["discovered_from"]) for r in graph.crawl(edges, seeds, depth=1, max_nodes=3).collect()}
    assert got == {"s": (0, 0, []), "a": (1, 1, ["s"]), "b": (1, 1, ["s"]), "c": (1, 1, ["s"]), "d": (2, 2, ["a", "b"])}


def test_import_reasons(spark):
    rows = [("h1", None, None, 0), ("h1", None, None, 1), ("h2", None, "id1", 2), ("h3", None, "id1", 3), ("h4", None, "id9", 4), ("h5", None, None, 5), ("h6", None, None, 6), (" ", None, None, 7)]
    r = spark.createDataFrame(rows, "handle string, name string, source_profile_id string, seq long")
    stored = spark.createDataFrame([("h5", None), ("zz", "id9")], "handle string, source_profile_id string")
    out = graph.tag_imports(r, stored, spark.createDataFrame([("h6",)], "handle string"))
    assert {x["seq"]: x["reason"] for x in out.collect()} == {0: None, 1: "duplicate", 2: None, 3: "collapsed_alias", 4: "stored_id", 5: "stored_handle", 6: "excluded_file"}
    counts = {x["reason"]: x["n"] for x in graph.import_summary(out).collect()}
    assert counts[None] == 7 and counts["imported"] == 2


def test_names_meet_only_those_they_contain(spark):
    # All names of the place start alike: what meets stays in proportion to what is contained.
    members = [(f"s{n}", "here", f"member {n:09d}") for n in range(300)]
    left = spark.createDataFrame(members, "sig_a string, place string, outer string")
    right = spark.createDataFrame(members, "sig_b string, place string, name string")
    assert identity.name_meets(left, right).count() == 300
    rng, long = random.Random(5), "a long name of more than thirty-two characters"
    outer = [("".join(rng.choice("ab ") for _ in range(rng.randint(1, 8))), rng.choice("xy")) for _ in range(60)] + [(f"the {long} x", "x")]
    inner = [("".join(rng.choice("ab ") for _ in range(rng.randint(1, 4))), rng.choice("xy")) for _ in range(60)] + [(long, "x"), (long + "y", "x")]
    a = spark.createDataFrame([(str(i), p, n) for i, (n, p) in enumerate(outer)], "sig_a string, place string, outer string")
    b = spark.createDataFrame([(str(i), p, n) for i, (n, p) in enumerate(inner)], "sig_b string, place string, name string")
    got = identity.name_meets(a, b).filter("contains(outer, name)").select("sig_a", "sig_b").collect()
    want = {(str(i), str(k)) for i, (x, p) in enumerate(outer) for k, (y, q) in enumerate(inner) if p == q and y in x}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
