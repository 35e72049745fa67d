import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from paddock.llm import conversation_repair as cr
from paddock.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
EXTRA = ["1 AS seq", "2 AS state", "'x' AS edit", "0 AS conv", "1 AS at", "'y' AS digest"]


def fault_codes(rows):
    out, seen = [], set()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        if not said:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def best_edits(initials, fault):
    """Least (cost, initials) by a table over (row, state), forward, keeping whole strings."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                to, new = wanted[state], (cost + 2, audit + "I")
                if to not in table or new < table[to]:
                    table[to] = new
        return table
    table = inserts({"": (0, "")})
    for initial, f in zip(initials, fault, strict=True):
        new = {}

        def put(state, value, new=new):
            if state not in new or value < new[state]:
                new[state] = value
        for state, (cost, audit) in table.items():
            put(state, (cost + 3, audit + "D"))
            if f not in ("blank", "duplicate"):
                extra = f == "truncated"
                put(wanted[state], (cost + 2 + extra, audit + "R"))
                if (state, initial) in legal:
                    put(legal[state, initial], (cost + extra, audit + "K"))
        table = inserts(new)
    return min(v for s, v in table.items() if s in ("", "a"))


def brute(rows):
    """The contract's row for (turn, role, text) rows in order."""
    fault = fault_codes(rows)
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = best_edits(initials, fault)
    lines, at, last = [], 0, ""
    for edit in audit:
        other = "assistant" if last == "u" else "user"
        if edit == "I":
            lines.append(other + ":")
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            lines.append(f"{role if edit == 'K' else other}:{text}")
        last = lines[-1][:1]
    turns = {t for t, _, _ in rows if t is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault.count("blank"), fault.count("duplicate"),
            fault.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost,
            audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", " ", "User"]
    return [(rng.choice([None, rng.randrange(3 * n)]), rng.choices(roles, [9, 9, 2, 1, 1, 1, 1])[0],
             rng.choice(["a.", "b", "", " \t", "c!", "hi? ", f"t{rng.randrange(9)}."])) for _ in range(n)]


@pytest.mark.parametrize("block", [4_096, 8])
def test_summary_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(block)
    convs = {i: random_rows(rng, rng.choice([1, 2, 3, 5, 9, 30, 150])) for i in range(60)}
    convs[None] = random_rows(rng, 20)
    table = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA).selectExpr("*", *EXTRA)
    got = {r.conv_id: tuple(r)[1:] for r in cr.summary(cr.repair(table)).collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        assert got[c] == brute(in_order(rows)), (c, rows)


def test_cheapest_of_all_strings_on_short_conversations():
    """The table of the brute force itself, and the walk, against every edit string."""
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}

    def run(audit, initials, fault):
        cost, at, state = 0, 0, ""
        for e in audit:
            if e == "I":
                cost, state = cost + 2, wanted[state]
                continue
            if at == len(initials):
                return None
            initial, f, at = initials[at], fault[at], at + 1
            if e == "D":
                cost += 3
                continue
            if f in ("blank", "duplicate") or (e == "K" and initial != wanted[state] and (initial != "s" or state)):
                return None
            cost += (f == "truncated") + (2 if e == "R" else 0)
            state = initial if e == "K" else wanted[state]
        return cost if at == len(initials) and state in ("", "a") else None

    names = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 3)
        initials, fault = rng.choices("suat", k=n), rng.choices(list(names), [4, 1, 1, 2], k=n)
        every = (("".join(a), run(a, initials, fault)) for k in range(n, n + 4)
                 for a in itertools.product("DIKR", repeat=k))
        best = min((c, a) for a, c in every if c is not None)
        assert best_edits(initials, fault) == best
        codes = np.array([["suat".index(i) + 4 * names[f] for i, f in zip(initials, fault, strict=True)]])
        _, inserted, edits, state = cr.walk(codes, cr.last_vector()[None, :], np.zeros(1, np.int64))
        audit = "".join("I" * m + e for m, e in zip(inserted[0].tolist(), edits[0].tolist(), strict=True))
        assert audit + {0: "", 1: "II", 2: "I", 3: ""}[int(state[0])] == best[1]


def test_one_long_conversation_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", 64)
    rng = random.Random(8)
    rows = [(i, rng.choice(["user", "assistant"]), f"{rng.randrange(4000)}" + rng.choice([".", ""])) for i in range(3000)]
    table = spark.createDataFrame([(1, *r) for r in rows], SCHEMA)
    (got,) = cr.summary(cr.repair(table)).collect()
    assert tuple(got)[1:] == brute(rows)


def test_long_text_and_empty_table(spark):
    table = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "ok.")], SCHEMA)
    (got,) = cr.summary(cr.repair(table)).collect()
    assert got.audit == "KK" and got.cost == 0
    assert cr.summary(cr.repair(table.limit(0))).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    given = []
    for c in [*range(150), None]:
        for t in [*range(rng.randint(1, 7)), *([None] if rng.random() < .1 else [])]:
            text = rng.choice([None, f"a. b! {t}.", f"c {t}", "d?"])
            given.append((c, t, rng.choice(["user", "assistant", "system", None]), text))
    spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {c for c, *_ in given}
    for c in got:
        rows = []
        for _, t, role, text in (r for r in given if r[0] == c):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = role if role is not None else " ", text if text is not None else " "
            if kind == 1:
                text = ""
            if kind == 2:
                text = "".join(x for x in text if x not in ".!?")
            rows += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        assert got[c] == brute(in_order(rows)), c
