from __future__ import annotations

import hashlib
import random
import zlib
from itertools import product

import pytest

from waymark.llm import conversations
from waymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"
ZERO = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def cheapest(codes):
    """(cost, audit) by dynamic programming over whole strings, with up to three inserts at a place."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = 3 if s == 2 else 2
                best[t] = min(best.get(t, (10**9, "")), (c + 3, a + "I"))
        return best

    for code in codes:
        new = {}
        for s, (c, a) in inserted(best).items():
            ways = [(s, c + 4, a + "D")]
            if code != "d":
                late = 3 * code.isupper()
                ways.append((3 if s == 2 else 2, c + 3 + late, a + "R"))
                if (s, code.lower()) in conversations.AFTER:
                    ways.append((conversations.AFTER[s, code.lower()], c + late, a + "K"))
            for t, *way in ways:
                new[t] = min(new.get(t, (10**9, "")), tuple(way))
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def brute(rows):
    """The contract's columns for each conversation of damaged rows (conv_id, turn, role, text, copies)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        if not own:
            out[conv] = ZERO
            continue
        seen, codes, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            kept = text.strip(SPACE)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            code = "d" if fault in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes.append(code.upper() if fault == "truncated" else code)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(codes)
        lines, it, state = [], iter(own), 0
        for letter in audit:
            if letter == "I":
                name, text = ("assistant" if state == 2 else "user"), ""
            else:
                _, role, text = next(it)
                if letter == "D":
                    continue
                name = role if letter == "K" else "assistant" if state == 2 else "user"
            state = conversations.AFTER[state, name[:1]]
            lines.append(f"{name}:{text}")
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    """Damaged rows (conv_id, turn, role, text, copies) by the contract's rule."""
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        out.append((c, t, "user" if kind == 4 else r, x, {0: 0, 3: 2}.get(kind, 1)))
    return out


def got(df):
    return {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    out = QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert got(out) == brute(damage(rows)) and out.count() == len({r[0] for r in rows})


def test_dijkstra_finds_the_least_key():
    for n in range(5):
        for codes in product(conversations.CODES, repeat=n):
            (_, cost, audit), = conversations.solve("".join(codes), 0, (0, 3))
            assert (cost, audit) == cheapest(codes)
    rng = random.Random(1)
    for n in (30, 200, 700):
        codes = "".join(rng.choices(conversations.CODES, k=n))
        (_, cost, audit), = conversations.solve(codes, 0, (0, 3))
        assert (cost, audit) == cheapest(codes)
        cuts = sorted(rng.choices(range(n + 1), k=5))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        assert conversations.joined([conversations.moves(p) for p in parts]) == (cost, audit)


def messy(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "user "]
    texts = ["Yes.", "No", "", " \n", None, "What?", "é!", "Fine. ", "x" * 5000 + ".", "a.b"] + [f"Line {i}." for i in range(40)]
    turn = lambda: rng.choice([None, rng.randrange(-3, 40)])
    return [(rng.choice([None, *range(n // 12)]), turn(), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("piece", [2, 4096])
def test_pieces_and_ranges_do_not_change_the_result(spark, piece):
    rows = messy(piece, 500) + [(777, t, ("user", "assistant", "system")[t % 3], f"Turn {t % 150}" + ".!x"[t % 3]) for t in range(400)]
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    assert got(conversations.repair_digests(conversations.damaged(df), piece)) == brute(damage(rows))


def test_repaired_rows_follow_the_audit(spark):
    rows = messy(9, 300)
    df = conversations.damaged(spark.createDataFrame(rows, TURNS))
    digests = {c: r[-1] for c, r in got(conversations.repair_digests(df)).items()}
    found = {}
    for r in conversations.repaired(df).orderBy("conv_id", "position").collect():
        assert r["edit"] in "KRI" and (r["edit"] != "I" or r["text"] == "")
        found.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, digest in digests.items():
        assert hashlib.sha256("\n".join(found.get(c, [])).encode()).hexdigest() == digest


def test_cases(spark):
    none = spark.createDataFrame([], TURNS)
    assert got(conversations.repair_digests(conversations.damaged(none))) == {}
    kept = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, "assistant", "Ho."), (2, 1, "sys", None), (3, 1, "user", "Only")]
    df = spark.createDataFrame([(*r, 1) for r in kept] + [(4, 0, "user", "gone", 0)], TURNS + ", copies long")
    out = got(conversations.repair_digests(df.selectExpr("*", "1 AS audit", "2 AS mark")))
    assert out == brute([(*r, 1) for r in kept] + [(4, 0, "user", "gone", 0)])
    assert out[1][:7] == (0, 0, 1, 0, 1, 4, "KDK") and out[2][:7] == (0, 1, 0, 0, 0, 4, "D") and out[4] == ZERO
    assert out[3][:7] == (0, 0, 0, 1, 0, 4, "D")
