import hashlib
import random
import re
import zlib

import pytest

from peopleweave.llm import conversations as C
from peopleweave.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, copies string"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """Whole conversations by a table over (row, state), backwards, without segments or search."""
    convs, order = {}, lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    for conv, turn, role, text, *_ in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=order)
        seen, faults = set(), []
        for _, role, text in kept:
            shown = text.strip(SPACE)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {(len(kept), q): None for q in "0sua"}
        best[len(kept), "0"] = best[len(kept), "a"] = (0, "")
        for i in range(len(kept), -1, -1):
            for q in "0sua":
                if i < len(kept):
                    _, role, _ = kept[i]
                    options = [(4, "D", q)]
                    if faults[i] not in ("blank", "duplicate"):
                        more = 3 if faults[i] else 0
                        options += [(more, "K", role[0])] if role and q + role[0] in ("0s", "0u", "su", "ua", "au") else []
                        options += [(3 + more, "R", "a" if q == "u" else "u")]
                    found = [(c + best[i + 1, t][0], e + best[i + 1, t][1]) for c, e, t in options if best[i + 1, t]]
                    best[i, q] = min(found) if found else None
            for _ in range(3):
                for q in "0sua":
                    then = best[i, "a" if q == "u" else "u"]
                    if then:
                        best[i, q] = min(filter(None, [best[i, q], (3 + then[0], "I" + then[1])]))
        cost, audit = best[0, "0"]
        q, at, turns = "0", 0, []
        for e in audit:
            role, text = ("", "") if e == "I" else kept[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if q == "u" else "user"
            q = role[0]
            turns.append(f"{role}:{text}")
        numbers = [t for t, _, _ in kept if t is not None]
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(kept, kept[1:]))
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in C.repair(C.damage(spark.createDataFrame(rows, SCHEMA)), **options).collect()), key=str)


def talk(n, seed, conv=None):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ok. ", "a.b", "Was\tist das?\x0b", "x" * 50 + "."]
    return [(conv if conv is not None else rng.randint(0, n // 5), rng.choice([None, *range(30)]) if conv is None else i // 2, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]),
             rng.choice([None, *said, *[f"Turn {i}." for i in range(9)]]), "x") for i in range(n)]


def test_equals_a_plain_table(spark):
    rows = talk(900, 1) + [(None, 0, "user", "Hi.", "x"), (None, None, None, None, "x"), (7000, 3, "user", "", "x"), (7001, 1, "system", "Be brief.", "x"), (7002, 0, "user", "long " * 50_000 + ".", "x"), (7002, 1, "assistant", "Ok.", "x")]
    rows += rows[:5] * 3
    assert run(spark, rows) == plain(rows)


def test_long_conversations_are_cut_and_folded(spark):
    rows = talk(200, 2) + talk(230, 3, conv=5000) + talk(150, 4, conv=5001) + [(5002, None, "user", "Same.", "x")] * 90 + [(5002, 4, "assistant", "Fine.", "x")] + [(None, i, "user", f"{i}.", "x") for i in range(120)]
    assert run(spark, rows, long_rows=40, segment_rows=7) == plain(rows)
    assert run(spark, rows, long_rows=100, segment_rows=16) == plain(rows)


def test_no_rows_and_dropped_rows(spark):
    assert run(spark, []) == []
    gone = next((c, 0, "user", "Hi.", "x") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [gone]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("rows, want", [
    ([], (0, "")), ([("u", "", 1), ("a", "", 1)], (0, "KK")), ([("u", "", 1)], (3, "KI")), ([("a", "", 1)], (3, "IK")), ([("u", "truncated", 1)], (4, "D")),
    ([("s", "", 1)], (4, "D")), ([("u", "", 1), ("u", "", 1)], (3, "KR")), ([("u", "", 3), ("a", "", 1)], (8, "KDDK"))])
def test_cheapest_then_least_edits(rows, want):
    assert C.search(rows, C.EMPTY, C.ENDS)[1:] == want


def test_unreachable_states_end_the_search():
    assert C.search([("u", "", 1)], C.USER, (C.EMPTY,)) is None and C.search([("u", "", 1)], C.EMPTY, (C.SYSTEM,)) is None
    assert C.search([("s", "", 1)], C.EMPTY, (C.SYSTEM,)) == (C.SYSTEM, 0, "K")


def test_registered_query(spark, tmp_path):
    rows = talk(300, 9)
    spark.createDataFrame(rows, SCHEMA).drop("copies").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()), key=str) == plain(rows)
