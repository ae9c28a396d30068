"""Conversation repair against a search over all edits."""
import hashlib
import random
import re
import zlib

import pytest

from tenura.llm import conversations
from tenura.llm.conversations import Audits

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """rows of (role, text, fault) -> (cost, audit, repaired): plain strings for every state."""
    best = {0: (0, "", ())}

    def inserts(best):
        for _ in range(2):
            for s, (c, a, t) in list(best.items()):
                x = (c + 3, a + "I", (*t, ("user:", "assistant:")[NEXT[s] == 3]))
                if NEXT[s] not in best or x[:2] < best[NEXT[s]][:2]:
                    best[NEXT[s]] = x
        return best
    for role, text, fault in rows:
        after = {}
        for s, (c, a, t) in inserts(dict(best)).items():
            found = [(s, c + 4, a + "D", t)]
            if fault < 2:
                k = KEPT.get((s, role[:1]))
                if k is not None:
                    found.append((k, c + 3 * fault, a + "K", (*t, f"{role}:{text}")))
                found.append((NEXT[s], c + 3 + 3 * fault, a + "R", (*t, f"{('user', 'assistant')[NEXT[s] == 3]}:{text}")))
            for to, *x in found:
                if to not in after or tuple(x[:2]) < after[to][:2]:
                    after[to] = tuple(x)
        best = after
    return min((x for s, x in inserts(best).items() if s in (0, 3)), key=lambda x: x[:2])


def exhaustive(rows):
    """(cost, audit) over all edit lists with at most two inserts in a gap."""
    out = []

    def go(i, s, c, a):
        for k in range(3):
            if i == len(rows):
                if s in (0, 3):
                    out.append((c, a))
            else:
                initial, fault = rows[i]
                go(i + 1, s, c + 4, a + "D")
                if fault < 2:
                    if (s, initial) in KEPT:
                        go(i + 1, KEPT[s, initial], c + 3 * fault, a + "K")
                    go(i + 1, NEXT[s], c + 3 + 3 * fault, a + "R")
            s, c, a = NEXT[s], c + 3, a + "I"
    go(0, 0, 0, "")
    return min(out)


def brute(rows):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    damaged = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        damaged[c] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for c, d in damaged.items():
        d.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        n, seen, faults = [0, 0, 0], set(), []
        for _, role, text in d:
            t = text.rstrip(" \t\n\x0b\x0c\r")
            kind = 0 if not t else 1 if (role, text) in seen else 2 if t[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                n[kind] += 1
            faults.append((role, text, 2 if kind < 2 else 1 if kind == 2 else 0))
        turns = {t for t, *_ in d if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(d, d[1:], strict=False))
        cost, audit, lines = cheapest(faults) if d else (0, "", ())
        out.append((c, gaps, *n, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=str)


def some_rows(n, seed=2):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t\n", "Why? ", None, "Ünï.\n", "x" * 50, "a:b", "two\nlines."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usr", "sys"]
    return [(rnd.choice([None, *range(12)]) if rnd.random() < 0.5 else 77, rnd.choice([None, *range(30)]),
             rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"line {rnd.randint(0, 99)}.") for _ in range(n)]


def test_the_dp_against_all_edits():
    rnd = random.Random(4)
    for _ in range(150):
        rows = [(rnd.choice("suax"), rnd.choice([0, 0, 1, 2])) for _ in range(rnd.randint(0, 5))]
        audits = Audits()
        best = [(0, 0), None, None, None]
        for r in rows:
            best = conversations.step(audits, best, *r)
        cost, node = conversations.final(audits, best)
        want = exhaustive(rows)
        assert (cost, audits.text(node)) == want
        assert cheapest([(i, "", f) for i, f in rows])[:2] == want


def test_audits_share_prefixes_and_survive_collisions(monkeypatch):
    rnd = random.Random(6)
    for same_hash in (False, True):
        if same_hash:
            monkeypatch.setattr(conversations, "_label_hash", lambda label: 0)
        audits, nodes = Audits(), {}
        for _ in range(300):
            s = "".join(rnd.choice("DIKR") for _ in range(rnd.randint(0, 9)))
            n = 0
            for c in s:
                n = audits.child(n, c)
            assert nodes.setdefault(s, n) == n and audits.text(n) == s
        some = rnd.sample(sorted(nodes), min(60, len(nodes)))
        for a in some:
            for b in some:
                assert audits.less(nodes[a], nodes[b]) == (a < b)
        assert len(audits.label) == 1 + len({s[:i] for s in nodes for i in range(1, len(s) + 1)})


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = some_rows(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = got(conversations.repair_report(df))
    assert out == brute(rows)
    assert max(len(r[7]) for r in out) > 150


def test_a_conversation_that_loses_every_row_and_an_empty_table(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hi.")]
    out = got(conversations.repair_report(spark.createDataFrame(rows, SCHEMA)))
    assert out == brute(rows) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(conversations.repair_report(spark.createDataFrame([], SCHEMA))) == []


def test_clashing_columns_very_long_texts_and_ties(spark):
    rows = [(1, 0, "user", "word " * 50_000 + "end."), (1, 1, "assistant", " " * 100_000), (1, 2, "user", "b."), (1, 2, "user", "a."),
            (1, 2, "user", "a."), (2, None, "user", "c.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as digest", "3 as tag", "4 as piece", "5 as kind",
                                                        "6 as copies", "7 as blank", "8 as id", "9 as cost")
    assert got(conversations.repair_report(df)) == brute(rows)
