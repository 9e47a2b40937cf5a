"""Cheapest repairs against a plain table of least costs and letters."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from docsieve.llm import conversation_repair as cr
from docsieve.llm import queries

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
AFTER = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, messages) of rows (turn, role, text)."""
    rows = sorted(
        ((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
        key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest()),
    )
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    best = {0: (0, "", ()), 2: (3, "I", ("assistant:",)), 1: (6, "II", ("user:", "assistant:")), 3: (0, "", ())}
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        taken = {}
        for q in range(4):
            c, a, m = best[q]
            ways = [(c + 4, "D" + a, m)]
            if fault not in ("b", "d"):
                extra = 3 if fault else 0
                to = KEEP.get((role[:1], q))
                if to is not None:
                    c, a, m = best[to]
                    ways.append((c + extra, "K" + a, (f"{role}:{text}", *m)))
                new, to = AFTER[q]
                c, a, m = best[to]
                ways.append((c + 3 + extra, "R" + a, (f"{new}:{text}", *m)))
            taken[q] = min(ways)
        best = {}
        for q in range(4):
            ways, at, letters, put = [taken[q]], q, "", ()
            for n in (1, 2, 3):
                new, at = AFTER[at]
                letters, put = letters + "I", (*put, new + ":")
                c, a, m = taken[at]
                ways.append((c + 3 * n, letters + a, put + m))
            best[q] = min(ways)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in "bdt"], illegal, best[0][0], best[0][1], list(best[0][2]))


def digest(got):
    return (*got[:7], hashlib.sha256("\n".join(got[7]).encode()).hexdigest())


TEXTS = ["One.", "Two!", "open end", "", " \n", "Why? ", "One.", "é"]
ROLES = ["user", "assistant", "system", "tool", "User", "a", "", None]


def some_rows(rng, n, turns):
    return [(rng.choice([None, *range(turns)]) if rng.random() < 0.9 else 10_000, rng.choice(ROLES[: rng.choice([2, 3, 8])]), rng.choice([*TEXTS, None, f"own {rng.random()}."])) for _ in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    groups = {i: some_rows(rng, rng.randrange(1, 9), rng.choice([3, 9])) for i in range(300)}
    groups[None] = some_rows(rng, 5, 4)
    groups[1000] = some_rows(rng, 700, 500)  # many blocks
    groups[1001] = [(t, "user", "Same.") for t in range(300)] + [(5, "user", "Same.")] * 200  # repeated rows and texts
    groups[1002] = [(t, "ua"[t % 2] + "x", f"{'long ' * 20_000}{t}.") for t in range(40)]
    groups[1003] = [(t, "su"[t % 2], f"{t}.") for t in range(130)]
    rows = [(c, t, r, x, 1, "clash") for c, rs in groups.items() for t, r, x in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, c int, edit string")
    got = {r.conv_id: tuple(r)[1:] for r in cr.report(cr.repair(df)).collect()}
    assert set(got) == set(groups)
    for c, rs in groups.items():
        want = brute(rs)
        assert got[c] == digest(want), c
    # The repaired rows are the messages.
    out = {}
    for r in cr.repair(df).where("conv_id < 50").toLocalIterator():
        if r.edit != "D":
            out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: out.get(c, []) for c in range(50)} == {c: brute(groups[c])[7] for c in range(50)}


def test_auction_prices_are_distances():
    rng = random.Random(4)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 4, 5, 6, 8, 9, 11, 12, 13]) for _ in range(rng.randrange(1, 70)))
        counts = tuple(rng.randrange(1, 4) if c % 4 > 1 else 1 for c in codes)
        ends = tuple(rng.randrange(7) for _ in range(4))
        best = list(ends)
        for code, n in zip(reversed(codes), reversed(counts), strict=True):
            taken = [min(cost + best[to] for _, cost, used, to in cr._arcs(code, n, q) if used) for q in range(4)]
            for _ in range(3):
                taken = [min(taken[q], 3 + taken[cr._NEXT[q]]) for q in range(4)]
            best = taken
        assert cr.solve(codes, counts, ends, 4)[0] == best


def test_text_keys(spark):
    df = spark.createDataFrame([("x", None, None, None), ("x", 2, "user", "Hi."), ("é", 1, "user", "Hi.")], "conv string, at int, who string, says string")
    got = {r.conv_id: tuple(r)[1:] for r in cr.report(cr.repair(df, "conv", "at", "who", "says"), "conv").collect()}
    assert got == {"x": digest(brute([(None, None, None), (2, "user", "Hi.")])), "é": digest(brute([(1, "user", "Hi.")]))}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cr.repair(df).count() == 0 and cr.repair_report(df).count() == 0


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kept = out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        if d:
            kept += [(t, "user" if d == 4 else r, "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x)] * (2 if d == 3 else 1)
    return out


def test_damage(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(12)]), *r) for r in some_rows(rng, 200, 30)]
    rows += [(77, t, "user", "Gone.") for t in range(100) if zlib.crc32(f"77:{t}".encode()) % 20 == 0]
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {c: digest(brute(rs)) for c, rs in damaged(rows).items()}
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.fixture(scope="module")
def whole(spark, sf):
    return queries.op11_conversation_repair(spark, sf).collect()


def test_query(whole, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    want = {c: digest(brute(rs)) for c, rs in damaged(rows).items()}
    assert len(whole) == len(want) and {r.conv_id: tuple(r)[1:] for r in whole} == want
