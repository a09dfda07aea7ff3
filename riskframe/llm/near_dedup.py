"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is a set of shingles of five words. Every shingle runs a Poisson process at the rate of its
weight, with arrival times and registers drawn from its hash; a register keeps the shingle that
arrives first. A shingle stops as soon as its next arrival would come after the latest of the
registers. Two texts agree in a register with the probability Jaccard similarity of their weighted
sets. All weights are 1 here, however often a shingle is repeated, so that this is the Jaccard
similarity by which links are verified.

Registers in bands give buckets. Every text gets a rank, the number of texts it meets in its
buckets; in each bucket all members are compared with the one of highest rank, the leader, which
in a group of near copies is the text closest to all. Verified links make components. Only where a
bucket still spans several components are its other pairs looked at: the members of one leader's
open buckets form a block, cut into tiles of at most two times ``TILE`` texts, and a tile reports
no more links than it has texts. So a group of near copies costs as many comparisons as members
unless its similarities straddle the threshold, and no pair that shares a bucket stays undecided.

A link needs a Jaccard similarity of ``THRESHOLD`` of the shingles themselves. Exact copies are one
node throughout. With ``BANDS`` bands of ``ROWS`` registers a pair at 0.8 is missed with probability
below 0.0001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling_hash as rh
from .common import free_name, materialise, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
TILE = 512
PIECE = 512 << 10  # characters of text that a Python worker hashes at once
SEGMENT = 32 << 10  # words hashed at once; sums and powers take 30 bytes for each of a text

U = np.uint64
_FACTORS = [U(f | 1) for f in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), ordered by both; a shorter text is one shingle."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = np.empty(len(start), np.uint64)
    for at in range(0, len(start), SEGMENT):
        first, some = start[at], slice(at, at + SEGMENT)
        word[some] = rh.substrings(rh.prefix(data[first : end[some][-1]]), start[some] - first, end[some] - first)
    limits = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(limits, start, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(doc)) - first[doc]
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    left = n[doc] - place
    for k in range(width):
        h += np.where(left > k, padded[k : k + len(doc)], U(k + 1)) * _FACTORS[k % len(_FACTORS)] ** U(1 + k // len(_FACTORS))
    keep = (left >= width) | (place == 0)
    doc, h = doc[keep], rh.mix(h[keep])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The element that arrives first in each register: an array of n_docs x registers."""
    first, out = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, np.uint64)
    d, e, w, time = doc, element, weight.astype(float), np.zeros(len(doc))
    single = np.bincount(doc, minlength=n_docs) == 1  # its element fills all registers
    live = ~single[d]
    d, e, w, time = d[live], e[live], w[live], time[live]
    turn = 0
    while len(d):
        turn += 1
        draw = rh.mix(e + U(turn * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log((draw >> U(11)).astype(float) / 2.0**53 + 2.0**-54) / w
        slot = d * registers + (rh.mix(draw ^ U(0xD1B54A32D192ED03)) % U(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]  # a later, earlier arrival writes over it
        out[slot[won]] = e[won]
        latest = first.reshape(n_docs, registers).max(1)
        go = time < latest[d]
        d, e, w, time = d[go], e[go], w[go], time[go]
    out = out.reshape(n_docs, registers)
    alone = single[doc]
    out[doc[alone]] = element[alone][:, None]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes, each without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _node(text: Column) -> Column:
    """Identity of a text, 128 bits; null for null."""
    return F.unhex(F.md5(text))


def _pieces(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive rows of up to ``PIECE`` characters of text, one row at least."""
    begin = size = 0
    for i, n in enumerate(map(len, part["text"])):
        if size and size + n > PIECE:
            yield part.iloc[begin:i]
            begin, size = i, 0
        size += n + 1
    if size:
        yield part.iloc[begin:]


def _bands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for piece in _pieces(part):
            doc, h, _ = shingles(list(piece["text"]))
            some, number = np.unique(doc, return_inverse=True)
            sig = signatures(number, h, np.ones(len(h)), len(some), BANDS * ROWS).reshape(len(some), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS)).copy()
            for r in range(ROWS):
                key = rh.mix(key * U(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pd.DataFrame({"node": piece["node"].to_numpy()[some], "bands": list(key.view(np.int64))})


def _check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    leader, own = None, np.empty(0, np.uint64)
    for part in parts:
        ok = []
        for a, s, t in zip(part["a"], part["a_text"], part["b_text"]):
            if a != leader:
                leader, own = a, shingles([s])[1]
            ok.append(jaccard(own, shingles([t])[1]) >= THRESHOLD)
        yield part.loc[ok, ["a", "b"]]


def _tile(rows: pd.DataFrame) -> list[tuple[bytes, bytes]]:
    """Links that join components among the texts of a tile; between its two chunks if it has two."""
    n = len(rows)
    doc, h, _ = shingles(list(rows["text"]))
    size = np.bincount(doc, minlength=n)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    doc, column = doc[keep], np.unique(column[keep], return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        some = slice(*np.searchsorted(column, [at, at + 2048]))
        m = np.zeros((n, 2048), np.float32)
        m[doc[some], column[some] - at] = 1
        shared += m @ m.T
    label = pd.factorize(rows["label"])[0]
    good = (shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-3) & (label[:, None] != label[None, :])
    if rows["i"].iloc[0] != rows["j"].iloc[0]:
        chunk = rows["chunk"].to_numpy()
        good &= chunk[:, None] != chunk[None, :]
    parent = list(range(int(label.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, node = [], list(rows["node"])
    for x, y in zip(*np.nonzero(np.triu(good, 1))):
        a, b = root(label[x]), root(label[y])
        s = int(shared[x, y])
        if a != b and s >= THRESHOLD * (int(size[x]) + int(size[y]) - s):
            parent[a] = b
            out.append((node[x], node[y]))
    return out


def _tiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in whole_groups(parts, ["a", "i", "j"], TILE):
        links = [x for _, tile in rows.groupby(["a", "i", "j"], sort=False) for x in _tile(tile)]
        yield pd.DataFrame(links, columns=["a", "b"])


def _verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough."""
    left = own.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = own.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a").select("a", "a_text", "b", "b_text")
    return materialise(both.mapInPandas(_check, "a binary, b binary"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the smallest node of its component.

    Large and small stars in turn until nothing changes: a logarithm of the longest path in rounds.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "near-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialise(small, "near-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def classes_of_texts(texts: DataFrame) -> DataFrame:
    """(node, label) of texts that have a near copy, from (node, text); see the module's text."""
    found = texts.mapInPandas(_bands, "node binary, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands"))
    rows = materialise(found, "near-bands").select("node", F.explode("bands").alias("h"))
    sizes = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, "h").select("h", "node", "n"), "near-shared")
    rank = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("rank"))
    leaders = shared.join(rank, "node").groupBy("h").agg(F.max(F.struct("rank", "node")).alias("top")).select("h", F.col("top.node").alias("a"))
    led = materialise(shared.join(leaders, "h").select("h", "node", "n", "a"), "near-led")
    pairs = led.where("node != a").select("a", F.col("node").alias("b")).distinct()
    # the texts that share a bucket are read once; a merge join at every size, as their number grows with the input
    own = texts.join(rank.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    own = materialise(own, "near-texts")
    links = _verified(materialise(pairs, "near-pairs"), own)
    labels = components(links)

    named = led.where("n > 2").join(labels, "node", "left").select("h", "node", "a", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    blocks = materialise(named.join(mixed, "h").select("a", "node", "label").distinct(), "near-blocks")
    if not blocks.take(1):
        return labels
    tiles = blocks.groupBy("a").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = blocks.join(tiles, "a").withColumn("chunk", F.pmod(F.hash("node"), "tiles"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.select("a", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "node", "label")
    tiled = members.join(own, "node").repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    more = materialise(tiled.mapInPandas(_tiles, "a binary, b binary"), "near-more")
    return components(links.union(more)) if more.take(1) else labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, node (the identity of its text), label (of the class).

    ``class_id`` is the smallest id of the class (null if all are), ``class_size`` its documents.
    Equal texts are always one class; texts without a word match nothing else. A null text is a
    class of its own. Repeated rows are members like others.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), _node(F.col(text_col)).alias("node"))
    texts = docs.where(F.col(text_col).isNotNull()).select(_node(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    labels = classes_of_texts(texts)
    named = own.where(F.col("node").isNotNull()).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    known = named.join(sizes, "label").select("doc_id", "class_id", "class_size", "node", "label")
    alone = own.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "node", F.col("node").alias("label"))
    return known.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns.

    Of repeated rows one stays. Documents without text stay.
    """
    node = free_name(docs, "node")[0]
    found = classes(docs, id_col, text_col).where(F.col("node").isNotNull())
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("node").alias(node), F.first("class_id").alias(f"{node}_id"))
    rows = docs.withColumn(f"{node}_own", _node(F.col(text_col)))
    same = (F.col(f"{node}_own") == F.col(node)) & F.col(id_col).eqNullSafe(F.col(f"{node}_id"))
    kept = rows.join(first, same, "left_semi").dropDuplicates([id_col, f"{node}_own"])
    return kept.unionByName(rows.where(F.col(text_col).isNull())).select(*docs.columns)
