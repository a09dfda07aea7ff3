"""Repairs equal an exhaustive dynamic programme, whole and cut into blocks."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from riskframe.llm import conversations as c, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def best(rows, start="", accept=("", "a")):
    """Cheapest edits, ties first in ASCII order, by working backwards over places and last roles."""
    n = len(rows)
    top = (10**9, "")
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    later = None
    for at in range(n, -1, -1):
        plain = {}
        for last in nxt:
            options = [(0, "")] if at == n and last in accept else []
            if at < n:
                forced, extra, role = rows[at]
                d = later[last]
                options.append((d[0] + 3, "D" + d[1]))
                if not forced:
                    if (last, role) in allowed:
                        options.append((later[role][0] + extra, "K" + later[role][1]))
                    r = later[nxt[last]]
                    options.append((r[0] + 2 + extra, "R" + r[1]))
            plain[last] = min(options, default=top)
        now = dict(plain)
        for _ in range(4):
            now = {k: min(plain[k], (now[nxt[k]][0] + 2, "I" + now[nxt[k]][1])) for k in nxt}
        later = now
    return later[start]


def brute(rows):
    """The contract in plain Python: rows (conv, turn, role, text) of one conversation before damage."""
    kept = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        k = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if k == 0:
            continue
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, states, faults = set(), [], [0] * 4
    for _, role, text in kept:
        f = 1 if not text.strip(SPACE) else 2 if (role, text) in seen else 3 if text.rstrip(SPACE)[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[f] += 1
        states.append((f in (1, 2), int(f == 3), role[:1]))
    cost, audit = best(states)
    out, at, last = [], 0, ""
    for e in audit:
        want = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[want]
        if e == "I":
            out.append(f"{name}:")
            last = want
            continue
        _, role, text = kept[at]
        at += 1
        if e == "K":
            out.append(f"{role}:{text}")
            last = role[:1]
        elif e == "R":
            out.append(f"{name}:{text}")
            last = want
    turns = [t for t, _, _ in kept if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: brute(v) for k, v in groups.items()}


def got(df, **options):
    return {r[0]: tuple(r)[1:] for r in c.report(df, **options).select(c.REPORT).collect()}


def random_rows(rng, conv, n):
    texts = ["Yes.", "No!", "Why?", "a long answer that ends", " ", "", "x.", "ok. ", None, "é漢.\n"]
    return [(conv, rng.choice([None, i, i, i, 3 * i]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for i in range(n)]


def test_search_equals_brute_force():
    rng = random.Random(7)
    names = {"": c.START, "s": c.SYSTEM, "u": c.USER, "a": c.ASSISTANT}
    for _ in range(1500):
        rows = [(rng.random() < 0.2, rng.choice([0, 0, 1]), rng.choice("uauasx")) for _ in range(rng.randint(0, 9))]
        assert c.search(rows) == best(rows)
        a, b = rng.choice(list(names)), rng.choice(list(names))
        cost, audit = best(rows, a, (b,))
        assert c.search(rows, names[a], (names[b],)) == (None if cost >= 10**9 else (cost, audit))
    long = [(rng.random() < 0.1, rng.choice([0, 0, 1]), rng.choice("uausx")) for _ in range(3000)]
    assert c.search(long) == best(long)


def test_whole_and_cut_conversations(spark):
    rng = random.Random(9)
    rows = [r for k in range(60) for r in random_rows(rng, k, rng.randint(1, 12))]
    rows += random_rows(rng, 1000, 700) + random_rows(rng, None, 40) + [(2000, 5, "user", "same.")] * 300 + [(2**60 + 1, 2**55 + 1, "user", "Big."), (2**60 + 1, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(x) for x in ("conv", "part", "number", "rows", "salt", "cost")])
    expected = want(rows)
    for block in (512, 7, 1):
        assert got(df, block=block) == expected


def test_one_large_conversation(spark):
    rng = random.Random(3)
    rows = random_rows(rng, 5, 6000)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert got(df) == want(rows)


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert c.report(spark.createDataFrame([], schema)).count() == 0
    gone = [k for k in map(str, range(400)) if zlib.crc32(f"{k}:1".encode()) % 20 == 0][:3]
    rows = [(k, 1, "user", "Gone.") for k in gone] + [("long", 1, "user", "word " * 200000), ("long", 2, "assistant", "Yes."), (None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    found = got(df)
    assert found == want(rows)
    assert all(found[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi there."), (1, 2, "user", "Hi there."), (1, 3, "assistant", "Hello"), (1, 4, "user", "Bye.")]
    counts, pieces = c.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert counts.first().asDict() == {"conv": 1, "n_rows": 5, "gaps": 0, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 1, "cost": 6, "audit": "KKDKKI"}
    out = [tuple(r) for p in pieces.orderBy("part", "number").collect() for r in p.rows]
    assert out == [("system", "Be kind."), ("user", "Hi there."), ("assistant", "Hello"), ("user", "Bye."), ("assistant", "")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.QUERIES["op11_deepening_repair"](spark, SF)
    assert {r[0]: tuple(r)[1:] for r in out.select(c.REPORT).collect()} == want(rows)
