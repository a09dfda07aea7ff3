"""Repeat intervals against every 200-byte string, by all ways through the operator."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import suffix_dedup as sd


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    blocks = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(8)]
    texts = []
    for _ in range(50):
        parts = [rng.choice(blocks) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 6))]
        cut = [p[rng.randint(0, len(p) // 3) :] for p in parts]
        texts.append(rng.choice(["", " ", "\n"]).join(cut))
    return texts + ["a" * 700, "a" * 199, "ab" * 300, None, "", texts[0], texts[0], blocks[0][:199], "x" * 200, "€" * 150 + "y", "€" * 150 + "z"]


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in sd.dedup(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("change", [{}, {"LARGE": 0}, {"BATCH": 1}, {"BLOCK": 450}])
def test_against_every_string(spark, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(sd, k, v)
    texts = corpus(len(str(change)))
    assert run(spark, texts) == brute(texts)


def test_intervals_of_a_suffix_array():
    text = b"banana$bandana#"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        lcp.append(n)
    got = {(d, frozenset(order[i:j + 1])) for d, i, j in sd.common_prefix_intervals(lcp, 2)}
    want = set()
    for d in range(2, len(text)):
        for s in {text[i : i + d] for i in range(len(text) - d + 1)}:
            at = [i for i in range(len(text)) if text.startswith(s, i)]
            if len(at) > 1 and len({text[i + d : i + d + 1] for i in at}) > 1:
                want.add((d, frozenset(at)))
    assert got == want


def test_odd_inputs(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    rows = [(1, text), (1, text), (None, "q" + text), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("k1", "k2", "n", "sha", "anchor", "run", "todo", "data")])
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.dedup(docs).collect())
    assert got == [(0, 501, 500), (1, 500, 500), (1, 500, 500), (2, 0, 0)]
    assert sd.dedup(docs.limit(0)).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    assert [x[1] for x in run(spark, [long, "!" + long[-300:]])] == [300, 300]
