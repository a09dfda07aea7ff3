"""Near-duplicate classes against brute force, hot buckets, odd inputs."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.llm import near_dedup as nd
from riskframe.llm import rolling_hash as rh

U = np.uint64


def shingle_set(text):
    w = text.encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """Smallest id of the component of each document; docs: (id, text), ids distinct."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, t, shingle_set(t or "")) for i, t in docs if t is not None]
    for k, (i, t, s) in enumerate(sets):
        for j, u, r in sets[:k]:
            if t == u or (s and r and len(s & r) >= 0.8 * len(s | r)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def near_texts(n, copies, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 150))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, copies)):
            new = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(new))
    return list(enumerate(out))


@pytest.mark.parametrize("tile", [512, 2])
def test_classes_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    docs = near_texts(40, 4) + [(9001, None), (9002, ""), (9003, ""), (9004, "  \n"), (9005, "one two"), (9006, "one  two")]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert got == want


def test_chain_of_neighbours_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(words[k * 12 : k * 12 + 150])) for k in range(15)]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and set(got.values()) == {0}


def test_lines_repeated_a_different_number_of_times(spark):
    """Equal but for the repeats of one line: similar sets, dissimilar counts."""
    docs = []
    for k, (n, times) in enumerate([(104, 30), (104, 10), (204, 20), (104, 60), (300, 200), (104, 30), (150, 45)]):
        body, line = " ".join(f"w{k}x{i}" for i in range(n)), " ".join(f"l{k}x{i}" for i in range(20))
        docs += [(2 * k, f"{body}\n{line}"), (2 * k + 1, body + f"\n{line}" * times)]
    want = brute(docs)
    assert all(want[i] == i - i % 2 for i, _ in docs)
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    shared, a, b = rng.integers(1, 1 << 62, 300), rng.integers(1, 1 << 62, 40), rng.integers(1, 1 << 62, 60)
    first = np.concatenate([shared, a]).astype(U)
    second = np.concatenate([shared, b]).astype(U)
    w1, w2 = rng.integers(1, 6, len(first)), rng.integers(1, 6, len(second))
    w2[:300] = w1[:300]
    one = nd.signatures(np.zeros(len(first), np.int64), first, w1, 1, 4096)[0]
    two = nd.signatures(np.zeros(len(second), np.int64), second, w2, 1, 4096)[0]
    p1 = dict(zip(first.tolist(), w1.tolist()))
    p2 = dict(zip(second.tolist(), w2.tolist()))
    every = set(p1) | set(p2)
    exact = sum(1 / sum(max(p1.get(y, 0) / p1[x], p2.get(y, 0) / p2[x]) for y in every) for x in p1 if x in p2)
    assert abs((one == two).mean() - exact) < 0.03
    assert nd.jaccard(np.sort(first), np.sort(second)) == len(set(p1) & set(p2)) / len(every)
    equal = nd.signatures(np.zeros(len(first), np.int64), first, np.ones(len(first), int), 1, 4096)[0]
    other = nd.signatures(np.zeros(len(second), np.int64), second, np.ones(len(second), int), 1, 4096)[0]
    assert abs((equal == other).mean() - 300 / 400) < 0.03


def test_group_around_the_threshold(spark, monkeypatch):
    """Copies of one text, each far enough from it to make pairs on both sides of 0.8."""
    monkeypatch.setattr(nd, "TILE", 32)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(150):
        new = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            new[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        docs.append((k, " ".join(new)))
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    key = lambda n: n.to_bytes(4, "big")
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(edges)
    links = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in nd.components(links).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)} | {201: 200, 202: 200}
    assert got == want


def test_keep_one_and_odd_inputs(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text + " end"), (1, text + " end"), (None, text), (7, None), (8, None), (None, "other"), (9, "long " * 50000), (1, "a text of its own, same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("node", "label", "a", "b", "class_id", "bands")])
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[-4:]) for r in kept.collect()) == [(-1, "ther"), (1, " end"), (1, "e id"), (7, ""), (8, ""), (9, "ong ")]
    assert nd.keep_one(docs.limit(0)).count() == 0 and nd.classes(docs.limit(0)).count() == 0


def test_buckets_of_a_batch_take_little_memory(monkeypatch):
    """A batch of 8 MB of text: pieces bound what is held beside it, and buckets do not depend on them."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=n)) for n in (1, 2, 7, *[400] * 3000, 40000, 400)]
    batch = pd.DataFrame({"node": [bytes([i % 256, i // 256]) for i in range(len(texts))], "text": texts})
    rh._powers.cache_clear()
    tracemalloc.start()
    most = 0
    for piece in nd._bands(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert most < 48 << 20

    some = batch.iloc[[*range(200), len(batch) - 2, len(batch) - 1]]
    whole = pd.concat(nd._bands(iter([some])))
    monkeypatch.setattr(nd, "PIECE", 3000)
    monkeypatch.setattr(nd, "SEGMENT", 7)
    cut = pd.concat(nd._bands(iter([some])))
    assert list(whole["node"]) == list(some["node"]) == list(cut["node"])
    assert np.array_equal(np.stack(whole["bands"]), np.stack(cut["bands"]))
