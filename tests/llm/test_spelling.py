"""Near words, forms and roots equal brute force, whatever the size of the groups."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from riskframe.llm import spelling as s


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= 10 * n else None, n, len(near))
    roots = {}
    for w in words:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        roots[w] = r
    return {(w, f, roots[w], n, k, words[f] if f else None) for w, (f, n, k) in out.items()}


def random_words(rng, n, alphabet="abé", low=1, high=9):
    found = {"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)}
    return {w: rng.choice([2, 2, 3, 20, 21, 40, 200, 2000, 20000]) for w in found}


def test_scan_of_sorted_words():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted(random_words(rng, 60, rng.choice(["ab", "abcde"]), 1, 7))
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
        got = list(s.near_in_sorted(words))
        assert len(got) == len(set(got)) and set(got) == want


def test_groups_of_any_size(spark):
    words = random_words(random.Random(5), 500)
    want = brute(words)
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("k", F.lit(1)).withColumn("form", F.lit("x"))
    for limit in (20000, 7):  # the second cuts keys down to one place
        assert {tuple(r) for r in s.group(df, limit=limit).collect()} == want


def test_runs_and_damage(spark):
    text = "ÀBCDEFG abcdef abcdefg-Straßenbahn ABCDEFG\x00abcdefgh naïveté÷×abc 1234567 ijklmnopq漢abcdefgé"
    rows = [(k, text) for k in range(200)] + [(None, text), (3, None), (3, ""), (7, "abcdefg " * 30000), (7, "abcdefg " * 30000), (5, text), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).withColumn("id", F.lit(1))
    count = Counter()
    letters = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
    for i, t in rows:
        for run in "".join(c if c in letters else " " for c in t or "").split(" "):
            if run:
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    assert {(r.word, r.n) for r in s.vocabulary(docs).collect()} == set(want.items())
    assert {tuple(r) for r in s.group(s.vocabulary(docs)).collect()} == brute(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.group(s.vocabulary(docs)).count() == 0
    assert s.group(spark.createDataFrame([("abcdefg", 5)], "word string, n long")).collect() == [("abcdefg", None, "abcdefg", 5, 0, None)]


def test_long_chains(spark):
    words = {"abcdefgh"[:-1] + "abcdefghijklmnop"[k]: 2 * 10**k for k in range(1)}
    words |= {"x" * k + "abcdefg": 2 * 10**k for k in range(12)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in s.group(df).collect()} == brute(words)
