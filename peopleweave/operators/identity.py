"""Identity resolution between two profile sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, IdentityConfig
from ..functions.arrays import or_empty
from ..functions.similarity import company_score, location_score, name_key, name_score
from ..functions.text import trim_ws
from ..session import cut_lineage
from .aggregates import identity_confidence, merged_summaries
from .common import best_row, positions, running_max
from .windows import primary_fields

FEATURES = ["display_name", "location", "words", "companies"]


def with_features(profiles: DataFrame) -> DataFrame:
    """Columns the pair score depends on. profiles: (profile_id, display_name, location, headline, bio, companies, ordinal)."""
    words = F.lower(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("bio", F.lit(""))))
    return profiles.withColumn("words", words).withColumn("companies", F.transform(or_empty("companies"), F.lower))


def signatures(profiles: DataFrame) -> DataFrame:
    """Profiles equal in every scored field share a signature: copies are scored once."""
    return profiles.withColumn("sig", F.sha2(F.to_json(F.struct(*FEATURES)), 256))


def pair_score(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """Sum name + location + company in that order (the order decides ties at .9) and its reasons."""
    n = name_score(F.col(f"{a}.display_name"), F.col(f"{b}.display_name"))
    loc = location_score(F.col(f"{a}.location"), F.col(f"{b}.location"))
    c = company_score(F.col(f"{a}.words"), F.col(f"{a}.companies"), F.col(f"{b}.words"), F.col(f"{b}.companies"))
    reasons = F.filter(F.array(*[F.struct(F.lit(s).alias("signal"), v.alias("confidence")) for s, v in (
        ("name_match", n), ("location_match", loc), ("company_signal", c))]), lambda r: r["confidence"] > 0)
    return F.least(F.lit(1.0), n + loc + c), reasons


def text_pieces(text: Column) -> Column:
    """Distinct substrings of one, two and three characters, and the empty one: three per character of the text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    # The size is read in the loop's own function: a second lambda parameter would be the element's index.
    def cut(size: int) -> Column:
        return F.transform(starts, lambda i: F.substring(text, i, size))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[cut(size) for size in (1, 2, 3)]))


def head_piece(text: Column) -> Column:
    """The piece that every text containing ``text`` has as well: its first three characters."""
    return F.substring(text, 1, 3)


NAME_PIECE = 32


def pieces_of(text: Column, size: Column) -> Column:
    """Distinct substrings of one size, for texts of that size at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def name_meets(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of ``outer`` (place, outer) with the rows of ``inner`` (place, name) whose name they may contain.

    They meet on the equal place and the whole name, or its first NAME_PIECE characters. Lengths that no name of the place has are not cut.
    """
    inner = inner.withColumn("piece", F.substring("name", 1, NAME_PIECE))
    sizes = inner.groupBy("place").agg(F.collect_set(F.length("piece")).alias("sizes"))
    parts = outer.join(sizes, "place").withColumn("size", F.explode("sizes")).filter(F.col("size") <= F.length("outer"))
    parts = parts.withColumn("piece", F.explode(pieces_of(F.col("outer"), F.col("size")))).drop("size", "sizes")
    return parts.join(inner, ["place", "piece"])


def signature_pairs(left: DataFrame, right: DataFrame, cfg: IdentityConfig = DEFAULT.identity) -> DataFrame:
    """Signature pairs reaching the review line, without a cross product and without losing any.

    Location and company give at most .5, so a pair above the .7 line has a name signal. Equal names (.5, or .4 with other
    spaces) need .2 more, which a shared role keyword (.1) alone is not: they meet on the name key with a shared place word, or with a
    piece of an organisation that the other's text contains. A contained name (.25) needs the equal location, so it
    meets on the location with the contained name itself. What meets is scored in full.
    """
    def distinct(df):
        return df.select("sig", *FEATURES).dropDuplicates(["sig"])

    a, b = distinct(left), distinct(right)

    def keyed(df):
        place = F.transform(F.filter(F.split(F.lower(trim_ws(F.coalesce("location", F.lit("")))), r"\s*[,/]\s*|\s+"), lambda t: t != ""),
                            lambda t: F.concat(F.lit("p:"), t))
        return df.withColumn("name_key", name_key("display_name")).filter(F.coalesce("name_key", F.lit("")) != "").withColumn("places", F.array_distinct(place))

    ka, kb = keyed(a), keyed(b)

    def placed(df, sig):
        return df.select(F.col("sig").alias(sig), "name_key", F.explode("places").alias("block"))

    same_name = placed(ka, "sig_a").join(placed(kb, "sig_b"), ["name_key", "block"]).select("sig_a", "sig_b")

    def mentioned(owner, text, owner_sig, text_sig):
        named = owner.select(F.col("sig").alias(owner_sig), "name_key", F.explode("companies").alias("company")).select(
            owner_sig, "name_key", head_piece(F.col("company")).alias("piece"))
        # Only texts whose name has an organisation on the other side are cut into pieces.
        texts = text.join(named.select("name_key").distinct(), "name_key", "left_semi")
        pieces = texts.select(F.col("sig").alias(text_sig), "name_key", F.explode(text_pieces(F.col("words"))).alias("piece"))
        return named.join(pieces, ["name_key", "piece"]).select("sig_a", "sig_b")

    same_name = same_name.unionByName(mentioned(ka, kb, "sig_a", "sig_b")).unionByName(mentioned(kb, ka, "sig_b", "sig_a"))

    def short(df):
        return df.select("sig", F.lower(trim_ws("display_name")).alias("name"), F.lower(trim_ws("location")).alias("place")).filter(
            (F.coalesce("name", F.lit("")) != "") & (F.coalesce("place", F.lit("")) != ""))

    sa, sb = short(a), short(b)

    def contained(outer, inner, outer_sig, inner_sig):
        met = name_meets(outer.withColumnRenamed("sig", outer_sig).withColumnRenamed("name", "outer"), inner.withColumnRenamed("sig", inner_sig))
        return met.filter(F.contains("outer", F.col("name"))).select("sig_a", "sig_b")

    inside = contained(sa, sb, "sig_a", "sig_b").unionByName(contained(sb, sa, "sig_b", "sig_a"))
    pairs = same_name.unionByName(inside).distinct()
    score, reasons = pair_score()
    joined = pairs.join(a.alias("a"), F.col("sig_a") == F.col("a.sig")).join(b.alias("b"), F.col("sig_b") == F.col("b.sig"))
    return joined.select("sig_a", "sig_b", score.alias("score"), reasons.alias("reasons")).filter(F.col("score") >= cfg.review_threshold)


def explicit_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) where ``linked_handles`` of the left side name a right handle; the score is 1.

    For links that the right side names, call it with the sides exchanged.
    """
    rows = left.select(F.col("profile_id").alias("left_id"), F.explode(or_empty("linked_handles")).alias("h"))
    return rows.join(right.select(F.col("profile_id").alias("right_id"), F.lower("handle").alias("h")), "h").select("left_id", "right_id").distinct()


def preference_lists(left: DataFrame, right: DataFrame, cfg: IdentityConfig = DEFAULT.identity) -> DataFrame:
    """(sig, right_id, right_order, score, reasons) for each left signature, explicit links first at 1.0.

    Lists belong to signatures, not rows: a third of all profiles being copies of one profile gives one
    list, not a list per copy. Linked handles are part of the left signature.
    """
    pairs = signature_pairs(left, right, cfg)
    members = right.select(F.col("sig").alias("sig_b"), F.col("profile_id").alias("right_id"), F.col("ordinal").alias("right_order"))
    group = left.select(F.col("sig").alias("sig_a"), F.col("group")).distinct()
    fuzzy = pairs.join(members, "sig_b").join(group, "sig_a").select("group", "right_id", "right_order", "score", "reasons")
    links = explicit_pairs(left, right).join(left.select(F.col("profile_id").alias("left_id"), "group"), "left_id").join(
        right.select(F.col("profile_id").alias("right_id"), F.col("ordinal").alias("right_order")), "right_id")
    sure = links.select("group", "right_id", "right_order", F.lit(1.0).alias("score"), F.array(F.struct(
        F.lit("explicit_github_link").alias("signal"), F.lit(1.0).alias("confidence"))).alias("reasons")).distinct()
    # An explicit link replaces the fuzzy score of the same pair, also when that one is 1 as well.
    both = sure.withColumn("p", F.lit(1)).unionByName(fuzzy.withColumn("p", F.lit(0)))
    return best_row(both, ["group", "right_id"], F.col("p")).drop("p")


def prepare(profiles: DataFrame) -> DataFrame:
    out = signatures(with_features(profiles))
    linked = or_empty("linked_handles") if "linked_handles" in profiles.columns else F.array().cast("array<string>")
    out = out.withColumn("linked_handles", F.array_sort(F.array_distinct(F.transform(linked, F.lower))))
    return out.withColumn("group", F.sha2(F.concat_ws("|", "sig", F.array_join("linked_handles", ",")), 256))


def shared_lists(merge: DataFrame) -> DataFrame:
    """(group, list, least and largest person of its rights): groups whose preference lists hold the same rights in the same order have the same list number.

    Two hashes of (right, place), summed up by xor, tell lists apart, so no list is gathered.
    """
    mark = [F.bit_xor(F.xxhash64("right_id", "pos", F.lit(seed))) for seed in (0, 1)]
    return merge.groupBy("group").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *mark), 256).alias("list"), F.min("right_person").alias("_first_person"), F.max("right_person").alias("_last_person"))


def resolve(left: DataFrame, right: DataFrame, identities: DataFrame, cfg: IdentityConfig = DEFAULT.identity,
            max_rounds: int | None = None) -> dict[str, DataFrame]:
    """Greedy one-to-one assignment, equal to walking the left profiles in order.

    All rights prefer the earlier left, so deferred acceptance ends in the same assignment: each round every open left asks a right of its list, each
    right keeps the earliest asker, and the others go on to a later place. Many lefts settle in a round, because demand is set against
    the places of a list as a whole: lefts with equal lists, of one group or of several, end at rising places in their order, so the k-th of them starts
    at place k, and one that has to move on moves all behind it that stand too close. Such a place is never behind the final one, so
    nothing is skipped. Rounds are bounded by the places there are to move over; ``max_rounds`` may bound them further. A pair whose two
    profiles already belong to different persons is a conflict: it holds the left but not the right, and ends as an
    error. Returns frames ``matches``, ``conflicts``, ``review``, ``singletons``.
    """
    known = identities.select("profile_id", "person_id")
    a = prepare(left).join(known.withColumnRenamed("person_id", "left_person"), "profile_id", "left")
    b = prepare(right).join(known.withColumnRenamed("person_id", "right_person"), "profile_id", "left")
    lists = cut_lineage(preference_lists(a, b, cfg))
    merge = positions(lists.filter(F.col("score") >= cfg.merge_threshold), ["group"], [F.desc("score"), "right_order", "right_id"], "pos")
    merge = cut_lineage(merge.join(b.select(F.col("profile_id").alias("right_id"), "right_person"), "right_id"))
    asking = a.select(F.col("profile_id").alias("left_id"), F.col("ordinal").alias("left_order"), "group", "left_person").join(shared_lists(merge), "group")
    other = (F.col("_first_person") != F.col("left_person")) | (F.col("_last_person") != F.col("left_person"))
    asking = asking.withColumn("_clashes", F.coalesce(other, F.lit(False))).drop("_first_person", "_last_person")
    fresh = positions(asking.filter("NOT _clashes"), ["list"], ["left_order", "left_id"], "place").withColumn("pos", F.col("place"))
    # A left with a person may stop at a right of another person without taking it, so it starts at the first place and moves alone.
    owned = asking.filter("_clashes").withColumns({"place": F.lit(None).cast("long"), "pos": F.lit(1).cast("long")})
    columns = ["left_id", "left_order", "group", "list", "left_person", "place", "pos"]
    state = cut_lineage(fresh.select(*columns).unionByName(owned.select(*columns)))

    def current(s):
        clash = F.coalesce(F.col("left_person") != F.col("right_person"), F.lit(False))
        return s.join(merge, ["group", "pos"]).withColumn("clash", clash)

    round_ = 0
    while max_rounds is None or round_ < max_rounds:
        round_ += 1
        asked = current(state)
        holders = asked.filter("NOT clash").groupBy("right_id").agg(F.min("left_order").alias("holder"))
        moved = cut_lineage(asked.join(holders, "right_id").filter(F.col("left_order") > F.col("holder")).select("left_id", "list", F.lit(1).alias("_m")))
        if moved.isEmpty():
            break
        state = state.join(moved.select("left_id", "_m"), "left_id", "left").withColumn("pos", F.col("pos") + F.coalesce("_m", F.lit(0))).drop("_m")
        # The k-th fresh left of a list stands at least at k more than any before it stands beyond its own number.
        touched = moved.select("list").distinct().withColumn("_t", F.lit(True))
        state = cut_lineage(state.join(touched, "list", "left"))
        still = state.filter("_t IS NULL OR place IS NULL")
        shifted = running_max(state.filter("_t AND place IS NOT NULL").withColumn("_lead", F.col("pos") - F.col("place")), ["list"], ["place"], "_lead", "_lead_upto")
        state = cut_lineage(still.select(*columns).unionByName(shifted.withColumn("pos", F.col("place") + F.col("_lead_upto")).select(*columns)))
    else:
        raise RuntimeError("assignment did not settle")
    final = cut_lineage(current(state))
    matches = final.filter("NOT clash").select("left_id", "right_id", "left_order", "score", "reasons", "left_person", "right_person")
    conflicts = final.filter("clash").select("left_id", "right_id", "score")
    # Review: an unmatched left whose best right not taken by an earlier left scores between the lines.
    taken = matches.select("right_id", F.col("left_order").alias("taken_by"))
    rest = a.select(F.col("profile_id").alias("left_id"), F.col("ordinal").alias("left_order"), "group").join(
        final.select("left_id"), "left_id", "left_anti")
    between = lists.filter(F.col("score") < cfg.merge_threshold).join(taken, "right_id", "left").select(
        "group", "right_id", "score", "taken_by")
    review = rest.join(between, "group").filter(F.col("taken_by").isNull() | (F.col("taken_by") > F.col("left_order")))
    review = review.groupBy("left_id").agg(F.max("score").alias("score"))
    used = matches.select(F.col("left_id").alias("profile_id")).unionByName(matches.select(F.col("right_id").alias("profile_id")))
    everyone = left.select("profile_id").unionByName(right.select("profile_id"))
    singles = everyone.join(used, "profile_id", "left_anti").join(known, "profile_id", "left_anti")
    return {"matches": matches, "conflicts": conflicts, "review": review, "singletons": singles}


def new_links(result: dict[str, DataFrame], cfg: IdentityConfig = DEFAULT.identity) -> DataFrame:
    """(person_id, profile_id, match_score): matched pairs on their existing or a new person, then singletons."""
    m = result["matches"]
    person = F.coalesce(F.col("left_person").cast("string"), F.col("right_person").cast("string"),
                        F.sha2(F.concat_ws("|", "left_id", "right_id"), 256))
    pairs = m.select(person.alias("person_id"), F.explode(F.array("left_id", "right_id")).alias("profile_id"), F.col("score").alias("match_score"))
    alone = result["singletons"].select(F.sha2("profile_id", 256).alias("person_id"), "profile_id",
                                        F.lit(cfg.singleton_confidence).alias("match_score"))
    return pairs.unionByName(alone)


def build_persons(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """Persons from their linked profiles. profiles: (profile_id, source, handle, display_name, headline, location, summary, bio, ordinal)."""
    rows = links.join(profiles, "profile_id").withColumn("seq", F.col("ordinal"))
    texts = rows.select("person_id", "source", "seq", F.explode(F.array("summary", "bio")).alias("text"))
    return (primary_fields(rows).join(merged_summaries(texts), "person_id", "left")
            .join(identity_confidence(links), "person_id"))


def attach_to_persons(existing: DataFrame, built: DataFrame) -> DataFrame:
    """New values where there are any, old ones kept otherwise; confidence never drops."""
    n = built.select("person_id", *[F.col(c).alias(f"n_{c}") for c in ("name", "headline", "location", "summary", "confidence")])
    j = existing.join(n, "person_id", "left")

    def pick(c):
        return F.coalesce(F.nullif(trim_ws(f"n_{c}"), F.lit("")), F.nullif(trim_ws(c), F.lit(""))).alias(c)

    keep = [c for c in existing.columns if c not in ("name", "headline", "location", "summary", "confidence")]
    return j.select(*keep, pick("name"), pick("headline"), pick("location"), pick("summary"),
                    F.greatest("confidence", "n_confidence").alias("confidence"))


def alias_rows(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """Aliases of linked profiles plus each profile's own handle. profiles: (profile_id, source, handle, aliases)."""
    j = links.select("person_id", "profile_id").join(profiles, "profile_id")
    own = F.array(F.struct(F.col("source").alias("type"), F.col("handle").alias("value"), F.lit(1.0).alias("confidence")))
    rows = j.select("person_id", "source", "profile_id", F.posexplode(F.concat(
        F.coalesce("aliases", F.array().cast("array<struct<type:string,value:string,confidence:double>>")), own)).alias("seq", "a"))
    flat = rows.select("person_id", F.col("a.type").alias("alias_type"), F.col("a.value").alias("alias_value"), "source",
                       F.col("a.confidence").alias("confidence"), F.struct("profile_id", "seq").alias("_o"))
    return best_row(flat, ["person_id", "alias_type", "alias_value"], F.col("_o"), maximum=False).drop("_o")


def persons_by_alias(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """First person per wanted (alias_type, alias_value)."""
    hit = wanted.select("alias_type", "alias_value").distinct().join(aliases, ["alias_type", "alias_value"])
    return hit.groupBy("alias_type", "alias_value").agg(F.min("person_id").alias("person_id"))


def backfill_headlines(persons: DataFrame, built: DataFrame) -> DataFrame:
    """Persons whose derived headline exists and differs from the stored one."""
    j = persons.select("person_id", "headline").join(built.select("person_id", F.col("headline").alias("new_headline")), "person_id")
    return j.filter(F.col("new_headline").isNotNull() & ~F.col("new_headline").eqNullSafe(F.col("headline"))).select("person_id", "new_headline")
