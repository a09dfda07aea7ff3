"""Repair of the turn structure of conversations by iterative-deepening A*.

The rows of a conversation, by turn, are edited at least cost until its roles read ``(s?(ua)+)?``:
a row is deleted (D, 3; needed for blank rows and repeats), kept (K, 0) or given the other role (R, 2), and rows
without text are inserted (I, 2); a truncated row that stays costs 1 more. The search goes depth
first and tries the edits in ASCII order within a bound on the cost. Costs that the rows to come
cannot do without are the heuristic. A state that failed, a place and the last role, is noted
with the least cost that it turned out to need, so that it is entered again only under a bound
that allows for it. The bound then rises to the least cost that exceeded it. The first path that
accepts is the cheapest, and of equals the first in ASCII order.

Rows are range-partitioned by conversation, turn, role and text, so that a busy conversation, or
one row of it repeated, spreads over partitions. Conversations that lie inside a partition and
have at most ``BLOCK`` rows are searched at once. Others are cut into blocks: each block is searched
from every role it may begin after to every role it may end with, and the blocks of a conversation
are chained by these small tables; repeats are found by a grouped minimum of places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 512  # rows that are searched together
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
SOLID = "[^\\x20\\x09-\\x0D]"  # not a space
END = "[.!?]"
ROWS = "array<struct<role: string, text: string>>"
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row kept was
NEVER = 1 << 60
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
OTHER = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # a user's or assistant's row that may follow
NAME = {USER: "user", ASSISTANT: "assistant"}
GOOD = {"su", "ua", "au"}


def search(rows: list[tuple[bool, int, str]], start: int = START, goals: tuple[int, ...] = (START, ASSISTANT)) -> tuple[int, str] | None:
    """Cost and edits that lead from ``start`` to one of ``goals``; None if none is ever reached.

    A row is (must be deleted, cost of keeping it, initial of its role).
    """
    goals = tuple(g for g in goals if g >= USER or g == start or (g == SYSTEM and start == START))
    if not goals:
        return None
    if goals == (SYSTEM,) and start == START and not any(not forced and role == "s" for forced, _, role in rows):
        return None  # system rows are never inserted
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][0] else rows[i][1])

    def moves(at: int, last: int) -> list[tuple[str, int, int, int]]:
        """Edits in ASCII order: letter, cost, place, last role."""
        if at == n:
            return [("I", INSERT, at, OTHER[last])]
        forced, extra, role = rows[at]
        out = [("D", DELETE, at + 1, last), ("I", INSERT, at, OTHER[last])]
        if not forced:
            after = STEP.get(role, {}).get(last)
            if after is not None:
                out.append(("K", extra, at + 1, after))
            out.append(("R", REROLE + extra, at + 1, OTHER[last]))
        return out

    failed: dict[tuple[int, int], int] = {}  # least cost that a state needs
    bound = rest[0]
    while True:
        over = NEVER
        path: list[str] = []
        # place, last role, cost so far, moves, next move, least cost found to be needed
        stack = [[0, start, 0, moves(0, start), 0, NEVER]]
        while stack:
            frame = stack[-1]
            at, last, cost, todo, k, need = frame
            if k == 0 and at == n and last in goals:
                return cost, "".join(path)
            if k < len(todo):
                frame[4] += 1
                letter, price, there, role = todo[k]
                least = max(rest[there], failed.get((there, role), 0))
                if cost + price + least > bound:
                    over = min(over, cost + price + least)
                    frame[5] = min(need, price + least)
                else:
                    path.append(letter)
                    stack.append([there, role, cost + price, moves(there, role), 0, NEVER])
                continue
            stack.pop()
            failed[at, last] = max(failed.get((at, last), 0), need)
            if stack:
                path.pop()
                above = stack[-1]
                price = above[3][above[4] - 1][1]
                above[5] = min(above[5], price + failed[at, last])
        bound = over


def edit(rows: list[tuple[str, str]], audit: str, start: int = START) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits."""
    out, at, last = [], 0, start
    for letter in audit:
        if letter == "I":
            last = OTHER[last]
            out.append((NAME[last], ""))
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            last = STEP[role[:1]][last]
            out.append((role, text))
        elif letter == "R":
            last = OTHER[last]
            out.append((NAME[last], text))
    return out


def _states(faults: list[int], roles: list[str]) -> list[tuple[bool, int, str]]:
    return [(f in (1, 2), TRUNCATED if f == 3 else 0, r[:1]) for f, r in zip(faults, roles)]


def _fault(base: list[int], repeat: list[bool]) -> list[int]:
    """First fault of each row: 1 blank, 2 repeat, 3 truncated, 0 none."""
    return [1 if b == 1 else 2 if r else b for b, r in zip(base, repeat)]


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in GOOD for a, b in zip(roles, roles[1:]))


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text, base) in order, range-partitioned, with the partition ``part``."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    base = F.when(body == "", 1).when(~F.substring(body, -1, 1).rlike(END), 3).otherwise(0)
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    d = d.withColumn("base", base.cast("int"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    # equal rows may be cut apart too
    d = d.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    return d.select(F.col("conv").cast("string").alias("conv"), "turn", "role", "text", "base", F.spark_partition_id().alias("part"))


def _conversations(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[list[list], int, bool]]:
    """Blocks of a partition's rows: columns, number, and whether they are a whole conversation."""
    held: list[list] | None = None
    number, first, cut = 0, True, False  # cut: the held rows go on with a conversation whose block was handed on
    for batch in batches:
        d = [c.to_pylist() for c in batch.columns]
        if held is not None:
            d = [x + y for x, y in zip(held, d)]
        keys, start = d[0], 0
        for i in range(1, len(keys) + 1):
            ends = i < len(keys) and keys[i] != keys[start]
            if ends or i - start == block:
                yield [c[start:i] for c in d], number, ends and not first and not cut and i - start < block
                number, start = number + 1, i
                first, cut = first and not ends, not ends
        held = [c[start:] for c in d] if start < len(keys) else None
    if held is not None:
        yield held, number, False


SCANNED = (
    f"conv string, part int, number int, whole boolean, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows {ROWS}, "
    "turns array<long>, bases array<int>")
_LONGS = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
ARROW = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _LONGS], ("audit", pa.string()),
                   ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("turns", pa.list_(pa.int64())), ("bases", pa.list_(pa.int32()))])
FRAME = 400  # conversations in a batch that is handed on


def _scan(block: int):
    def row(columns: list[list], number: int, whole: bool) -> dict:
        convs, turns, roles, texts, base, parts = columns
        out = {"conv": convs[0], "part": parts[0], "number": number, "whole": whole}
        if not whole:
            return out | {"rows": [{"role": r, "text": t} for r, t in zip(roles, texts)], "turns": turns, "bases": base}
        seen, repeat = set(), []
        for key in zip(roles, texts):
            repeat.append(key in seen)
            seen.add(key)
        faults = _fault(base, repeat)
        cost, audit = search(_states(faults, roles))
        known = [t for t in turns if t is not None]
        return out | {"n_rows": len(roles), "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "blank": faults.count(1), "duplicate": faults.count(2),
                      "truncated": faults.count(3), "illegal": _illegal(roles), "cost": cost, "audit": audit,
                      "rows": [{"role": r, "text": t} for r, t in edit(list(zip(roles, texts)), audit)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for columns, number, whole in _conversations(batches, block):
            held.append(row(columns, number, whole))
            if len(held) == FRAME:
                yield pa.RecordBatch.from_pylist(held, ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)

    return run


def _tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block of a conversation that is cut: costs and edits from every role before to every role at the end."""
    for d in parts:
        out = []
        for r in d.itertuples(index=False):
            roles, turns, first = [x["role"] for x in r.rows], r.turns, set(r.firsts if r.firsts is not None else ())
            faults = _fault(list(r.bases), [i not in first for i in range(len(roles))])
            states = _states(faults, roles)
            found = [search(states, a, (b,)) for a in range(4) for b in range(4)]
            known = [int(t) for t in turns if t is not None]
            out.append((r.conv, r.part, r.number, [f[0] if f else None for f in found], [f[1] if f else None for f in found], len(roles), faults.count(1), faults.count(2),
                        faults.count(3), _illegal(roles), roles[0][:1], roles[-1][:1], str(known[0]) if known else None, str(known[-1]) if known else None, len(set(known))))
        yield pd.DataFrame(out, columns=TABLE)


TABLE = ["conv", "part", "number", "costs", "audits", "n_rows", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "n_turns"]
TABLE_SCHEMA = ("conv string, part int, number int, costs array<long>, audits array<string>, n_rows long, blank long, duplicate long, truncated long, illegal long, "
                "head string, tail string, low string, high string, n_turns long")
CHAINED = ("conv string, part int, number int, first boolean, start int, piece string, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, "
           "cost long, audit string")


def _chain(d: pd.DataFrame) -> pd.DataFrame:
    """The best way through the tables of a conversation's blocks, and its counts."""
    d = d.sort_values(["part", "number"]).reset_index(drop=True)
    blocks = [[(int(c), a) if a is not None else None for c, a in zip(costs, audits)] for costs, audits in zip(d["costs"], d["audits"])]
    # least cost to accept from each role before each block
    least = [[NEVER] * 4 for _ in blocks] + [[0, NEVER, NEVER, 0]]
    for k in range(len(blocks) - 1, -1, -1):
        for a in range(4):
            least[k][a] = min([t[0] + least[k + 1][b] for b in range(4) if (t := blocks[k][4 * a + b])], default=NEVER)
    # among the cheapest ways the first edits decide; edits that are the start of others leave those to the next block
    last, picked = START, []
    for k, block in enumerate(blocks):
        ways = [(t[1], b) for b in range(4) if (t := block[4 * last + b]) and t[0] + least[k + 1][b] == least[k][last]]
        audit, after = min(ways)
        picked.append((last, audit))
        last = after
    heads, tails = d["head"].tolist(), d["tail"].tolist()
    known = [(int(a), int(b)) for a, b in zip(d["low"].tolist(), d["high"].tolist()) if not pd.isna(a)]
    distinct = int(d["n_turns"].sum()) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
    return pd.DataFrame({
        "conv": d["conv"], "part": d["part"], "number": d["number"], "first": [k == 0 for k in range(len(d))], "start": [p[0] for p in picked], "piece": [p[1] for p in picked],
        "n_rows": int(d["n_rows"].sum()), "gaps": known[-1][1] - known[0][0] + 1 - distinct if known else 0, "blank": int(d["blank"].sum()), "duplicate": int(d["duplicate"].sum()),
        "truncated": int(d["truncated"].sum()), "illegal": int(d["illegal"].sum()) + sum(a + b not in GOOD for a, b in zip(tails, heads[1:])), "cost": least[0][START],
        "audit": ["".join(p[1] for p in picked) if k == 0 else None for k in range(len(d))]})


def _apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in parts:
        new = [[{"role": a, "text": b} for a, b in edit([(x["role"], x["text"]) for x in r], p, int(s))] for r, p, s in zip(d["rows"], d["piece"], d["start"])]
        yield pd.DataFrame({"conv": d["conv"], "part": d["part"], "number": d["number"], "rows": new})


COUNTS = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Counts of each conversation, and its repaired rows in pieces.

    Counts: (conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit). Pieces: (conv, part,
    number, whole, rows), to be read in this order; ``rows`` are (role, text). Null roles and texts are
    one space; null turns come first, and rows of one turn are in the order of role and text; rows
    with a null conversation are one conversation. Other columns are left out. A conversation
    without rows has none in the results.
    """
    kind = rows.schema[conv].dataType
    every = materialise(_ordered(rows, conv, turn, role, text).mapInArrow(_scan(block), SCANNED), "conversations")
    whole, cut = every.where("whole"), every.where(~F.col("whole"))
    # repeats of conversations that are cut: the first place of each row
    place = cut.select("conv", "part", "number", F.posexplode("rows").alias("i", "r"))
    place = place.groupBy("conv", *[F.xxhash64(F.lit(k), "r.role", F.lit(k), "r.text").alias(f"h{k}") for k in (1, 2)]).agg(F.min(F.struct("part", "number", "i")).alias("p"))
    firsts = place.groupBy("p.part", "p.number").agg(F.collect_list("p.i").alias("firsts"))  # at most one list entry for each row of the block
    marked = cut.join(firsts, ["part", "number"], "left")
    turns = F.transform("turns", lambda t: t.cast("string"))  # whole numbers survive nulls beside them
    tables = marked.select("conv", "part", "number", "rows", turns.alias("turns"), "bases", "firsts").mapInPandas(_tables, TABLE_SCHEMA)
    chained = materialise(tables.groupBy("conv").applyInPandas(_chain, CHAINED), "conversation-blocks")
    edited = cut.select("part", "number", "conv", "rows").join(chained.select("part", "number", "start", "piece"), ["part", "number"])
    edited = edited.mapInPandas(_apply, f"conv string, part int, number int, rows {ROWS}")
    own = F.col("conv").cast(kind).alias("conv")
    counts = whole.select(own, *COUNTS).unionByName(chained.where("first").select(own, *COUNTS))
    pieces = whole.select(own, "part", "number", "whole", "rows").unionByName(edited.select(own, "part", "number", F.lit(False).alias("whole"), "rows"))
    return counts, pieces


def _lines(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def _hash_pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash the pieces of each conversation one after the other, as they come."""
    key, state, begun = None, None, False
    for d in parts:
        out = []
        for conv, lines in zip(d["conv"], d["lines"]):
            conv = None if pd.isna(conv) else conv
            if state is None or conv != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state, begun = conv, hashlib.sha256(), False
            if lines is not None:
                state.update(("\n" if begun else "").encode() + lines.encode())
                begun = True
        if out:
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if state is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["conv", "repaired_sha256"])


def hashes(pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the hash of each conversation's repaired rows as lines ``role:text``.

    Whole conversations are hashed where they are; pieces of others are brought together in order and hashed as they pass.
    """
    kind = pieces.schema["conv"].dataType
    whole = pieces.where("whole").select("conv", F.sha2(F.encode(_lines(F.col("rows")), "UTF-8"), 256).alias("repaired_sha256"))
    cut = pieces.where(~F.col("whole")).select(F.col("conv").cast("string").alias("conv"), "part", "number", F.when(F.size("rows") > 0, _lines(F.col("rows"))).alias("lines"))
    cut = cut.repartition("conv").sortWithinPartitions("conv", "part", "number").select("conv", "lines").mapInPandas(_hash_pieces, "conv string, repaired_sha256 string")
    return whole.unionByName(cut.select(F.col("conv").cast(kind).alias("conv"), "repaired_sha256"))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with faults put in by the checksum of ``conv:turn``; nulls are one space there and in role and text."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(clean(conv), F.lit(":"), clean(turn)).cast("binary")) % 20
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text"), kind.alias("kind")).where("kind > 0")
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", END, "")).otherwise(F.col("text"))
    d = d.withColumns({"text": new, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return d.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage, repair and digest every conversation of a table (conv_id, turn, role, text): ``REPORT``, one row each."""
    counts, pieces = repair(damaged(rows), "conv", block=block)
    both = counts.withColumn("repaired_sha256", F.lit(None).cast("string")).unionByName(hashes(pieces), allowMissingColumns=True)
    none = rows.select(F.col("conv_id").alias("conv")).distinct()
    both = both.unionByName(none, allowMissingColumns=True)
    found = both.groupBy("conv").agg(*[F.max(c).alias(c) for c in (*COUNTS, "repaired_sha256")])
    zero = F.lit(0).cast("long")
    return found.select(F.col("conv").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in REPORT[1:7]], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
