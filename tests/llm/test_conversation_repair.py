"""Conversation repair against a search over all edits, on odd rows, and its shared nodes."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from profilar.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
BIG = 1 << 60


def cheapest(signature):
    """Least (cost, audit) by a search over whole edit strings."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        shape = (at, "" if not roles else "s" if roles == "s" else roles[-1], audit)
        if shape in done:
            continue
        done.add(shape)
        options = [(5, "I", at, "u"), (5, "I", at, "a")]
        if at < len(signature):
            letter = signature[at]
            extra = 5 if letter.isupper() else 0
            options.append((2, "D", at + 1, ""))
            if letter != "x":
                options += [(1 + extra, "R", at + 1, "u"), (1 + extra, "R", at + 1, "a"), (extra, "K", at + 1, letter.lower())]
        for more, edit, nxt, role in options:
            if cost + more <= 2 * len(signature) and re.fullmatch("(s?(ua)*u?)?", roles + role):
                heapq.heappush(heap, (cost + more, audit + edit, nxt, roles + role))


def brute(rows):
    """The result for one conversation's rows (turn, role, text), texts and roles not NULL."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, signature, count = set(), "", {"b": 0, "d": 0, "t": 0, "n": 0}
    for turn, role, text in rows:
        cut = text.rstrip(" \t\n\x0b\f\r")
        fault = "b" if not cut else "d" if (role, text) in seen else "t" if cut[-1] not in ".!?" else "n"
        seen.add((role, text))
        count[fault] += 1
        letter = role[:1] if role[:1] in ("u", "a", "s") else "o"
        signature += "x" if fault in "bd" else letter.upper() if fault == "t" else letter
    cost, audit = cheapest(signature)
    out, left, first = [], list(rows), True
    for edit in audit:
        row = None if edit == "I" else left.pop(0)
        if edit == "D":
            continue
        nxt = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((row[1] if edit == "K" else nxt, "" if edit == "I" else row[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, out


def found(spark, rows, where=None):
    df = spark.createDataFrame([(*r, "clash", 0, "x") for r in rows], SCHEMA + ", key string, gone int, signature string")
    best = repair.audits(df, where=where).collect()
    again = spark.createDataFrame(best, repair.audits(df, where=where).schema)
    return {r["key"]: r for r in best}, df, again


def test_audits_equal_a_search():
    random.seed(5)
    some = {"".join(random.choice("uasoUASOx") for _ in range(random.randrange(9))) for _ in range(400)}
    got = {s: (cost, audit) for s, cost, audit in repair.best_audits(sorted(some, key=lambda s: s[::-1]))}
    assert got == {s: cheapest(s) for s in some}


def test_nodes_are_made_once(monkeypatch):
    """Signatures sorted from their ends make one node for each different suffix."""
    random.seed(6)
    some = {"".join(random.choice("uax") for _ in range(random.randrange(1, 12))) for _ in range(300)}
    made, plain = [], repair.node
    monkeypatch.setattr(repair, "node", lambda *a: made.append(1) or plain(*a))
    list(repair.best_audits(sorted(some, key=lambda s: s[::-1])))
    assert len(made) == len({s[k:] for s in some for k in range(len(s))})


def random_rows(keys, seed):
    random.seed(seed)
    rows = []
    for key in keys:
        for _ in range(random.randrange(1, 9)):
            rows.append((key, random.choice([None, 1, 2, 3, 4, 7, -2]), random.choice(["user", "assistant", "system", "tool", "", "ultra"]),
                         random.choice(["Yes.", "no", "", " \n", "Well? ", "a.\x0b", "ü!"])))
    return rows


def test_conversations_equal_brute_force(spark):
    rows = random_rows([*range(60), BIG + 1, BIG + 2, None], 7)
    got, df, best = found(spark, rows)
    assert set(got) == {r[0] for r in rows}
    hashes = {r["key"]: r["repaired_sha256"] for r in repair.digests(df, best).collect()}
    repaired = {}
    for r in sorted(repair.repair(df, best).collect(), key=lambda r: r["place"]):
        repaired.setdefault(r["key"], []).append((r["role"], r["text"]))
    for key in got:
        *counts, out = brute([r[1:] for r in rows if r[0] == key])
        assert [got[key][c] for c in (*repair.COUNTS, "cost", "audit")] == counts, key
        assert repaired.get(key, []) == out
        assert hashes[key] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "user", None), (2, None, "user", "Hi."), (2, None, "assistant", "Hi."), (3, -(1 << 63), "user", "x."),
            (3, (1 << 63) - 1, "assistant", "long " * 50_000 + "."), (4, 0, "user", "gone.")]
    got, df, best = found(spark, rows, ~(F.col("conv_id") == 4))
    assert got[1]["blank"] == 2 and got[1]["audit"] == "DD" and got[1]["cost"] == 4
    assert got[2]["audit"] == "RR" and got[2]["gaps"] == 0  # ties of turn by role: assistant first
    assert got[3]["audit"] == "KK" and got[3]["gaps"] == (1 << 63) - 1  # beyond a long: its largest value
    assert (got[4]["audit"], got[4]["cost"], got[4]["illegal"]) == ("", 0, 0)
    hashes = {r["key"]: r["repaired_sha256"] for r in repair.digests(df, best, where=~(F.col("conv_id") == 4)).collect()}
    assert hashes[4] == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], SCHEMA)
    none = repair.audits(empty)
    assert none.count() == 0 and repair.digests(empty, none).count() == 0 and repair.repair(empty, none).count() == 0


def test_long_and_repeated(spark):
    """One conversation with most rows, as many copies of one signature, and a text key."""
    long = [("long", k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(4001)]
    copies = [(f"c{k}", t, ("user", "assistant")[t], f"text {t}.") for k in range(2000) for t in range(2)]
    df = spark.createDataFrame(long + copies, SCHEMA.replace("conv_id long", "conv_id string"))
    got = {r["key"]: (r["cost"], r["audit"]) for r in repair.audits(df).collect()}
    assert len(got) == 2001 and got["c7"] == (0, "KK") and got["long"] == (2, "K" * 4000 + "D")


@pytest.mark.parametrize("signature,want", [("", (0, "")), ("u", (2, "D")), ("uu", (1, "KR")), ("sua", (0, "KKK")), ("UA", (4, "DD")),
                                            ("uaua" * 3 + "x", (2, "K" * 12 + "D")), ("suauauua", (2, "KKKKKDKK"))])
def test_examples(signature, want):
    (_, cost, audit), = repair.best_audits([signature])
    assert (cost, audit) == want == cheapest(signature)
