"""Byte-pair encoding by speculation and verification, and decoding.

Normalising and splitting a text into words are the tokenizer's own. A word's tokens are guessed by
greedy longest match. Every merge of the vocabulary has a rank, and a token's parts are made before
it is; so a guess is the exact encoding if, and only if, no merge across the border of two adjacent
tokens would have come before the merges that made them. That is decided for all adjacent pairs
of all new words of a batch at once, by walking the right edge of the left token and the left edge
of the right one back in time. Only words with a failing pair are merged exactly, with a heap.

A task remembers the words it met; once they are more than ``WORDS`` it forgets them all, which
costs time only.
The tokenizer's file is read once by the driver and broadcast: its size is fixed.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import free_name

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
WORDS = 400_000  # words that a task remembers
SLICE = 4_000_000  # characters of texts encoded before their rows are handed on
NEVER = np.int64(1 << 40)
# The public steps of this vocabulary's normaliser, the code points it takes for spaces among the first 256.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SOLID = re.compile(r"[^\t-\r \x85\xa0]+")
# Fixed value: the public pattern of its words. None holds a space, so the parts of a text between spaces are split one by one.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """The merge table of a vocabulary as arrays by token id."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        size = max(vocab.values(), default=-1) + 1
        self.size = size
        self.suffix = suffix
        self.inner, self.final = {}, {}
        for token, number in vocab.items():
            if suffix and token.endswith(suffix) and token != suffix:
                self.final[token[: -len(suffix)]] = number
            else:
                self.inner[token] = number
        if not suffix:
            self.final = self.inner
        self.longest = max(map(len, chain(self.inner, self.final)), default=1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        self.rank = {a * size + b: (k, c) for k, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.made[made] = rank
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made] = left, right
        key = left * size + right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], rank[order]
        # the proof needs one merge for each token, later than those of its parts
        self.sound = len(np.unique(made)) == len(made) and bool(np.all((self.made[left] < rank) & (self.made[right] < rank)))
        self.whole = np.ones(size, bool)  # tokens that encode to themselves
        if self.sound and len(made):
            fits = self.compatible(left, right, rank)
            for a, b, c, ok in zip(left.tolist(), right.tolist(), made.tolist(), fits.tolist()):
                self.whole[c] = ok and self.whole[a] and self.whole[b]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``NEVER`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens (before the given rank)."""
        a, b = left.astype(np.int64), right.astype(np.int64)
        used_a = np.full(len(a), NEVER) if before is None else before.copy()  # rank at which each symbol is merged away from the border
        used_b = used_a.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            m = self.pair_ranks(a[live], b[live])
            # of equal merges the one further left comes first
            cross = (m < used_a[live]) & (m <= used_b[live])
            ok[live[cross]] = False
            live = live[~cross]
            ma, mb = self.made[a[live]], self.made[b[live]]
            further = (ma >= 0) | (mb >= 0)
            live, ma, mb = live[further], ma[further], mb[further]
            at = live[ma > mb]
            used_a[at], a[at] = self.made[a[at]], self.right[a[at]]
            at = live[ma <= mb]
            used_b[at], b[at] = self.made[b[at]], self.left[b[at]]
        return ok

    def guess(self, word: str) -> list[int] | None:
        """Greedy longest match; None where a part of the word starts no token."""
        if word in self.final:
            return [self.final[word]]
        out, i, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while i < n:
            if n - i <= longest and (t := final.get(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + longest), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return out

    def exact(self, word: str) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until none is left."""
        found = [self.inner.get(c) for c in word[:-1]] + [self.final.get(word[-1:])]
        symbols = [s for s in found if s is not None]  # unknown symbols are left out
        n, size, rank = len(symbols), self.size, self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1] if n else []
        heap = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := rank.get(a * size + b))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j], k = made, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := rank.get(made * size + symbols[k]):
                    heapq.heappush(heap, (m[0], i, m[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (m := rank.get(symbols[h] * size + made)):
                heapq.heappush(heap, (m[0], h, m[1], symbols[h], made))
        return [s for s in symbols if s >= 0]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        if not self.sound:
            return [self.exact(w) for w in words]
        guesses = [self.guess(w) for w in words]
        sizes = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.fromiter(chain.from_iterable(g or () for g in guesses), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        np.logical_or.at(bad, owner[~self.whole[flat]], True)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[inside[~fits[which]]]] = True
        for i in np.flatnonzero(bad).tolist():
            guesses[i] = self.exact(words[i])
        return guesses


def _in_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Encodes and decodes texts as the tokenizer of a file does, in one task."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout") or model.get("unk_token"):
            raise ValueError("only plain byte-pair vocabularies are supported")
        tokenizer = Tokenizer.from_str(file)
        self.normalizer, self.splitter, self.decoder = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.decoder
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.spaceless = first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": SPACELESS}
        # texts of the first 256 code points are composed already and lower-cased one by one
        self.simple = self.spaceless and (spec.get("normalizer") or {}).get("normalizers") == NORMAL
        # an added token stands for itself under a key that no part of a text can be
        self.special = {t: f"\ud800{t}" for t in self.added}
        self.plain = {self.special[t]: (i,) for t, i in self.added.items()} | {"": ()}
        self.known: dict[str, tuple[int, ...]] = dict(self.plain)  # ids of parts of texts

    def _parts(self, text: str) -> list[str]:
        """The normalised text in parts that are split into words apart, and the added tokens it holds."""
        out: list[str] = []
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[piece])
            elif self.simple and _in_latin1(piece):
                out += SOLID.findall(piece.lower())
            elif piece:
                piece = self.normalizer.normalize_str(piece) if self.normalizer else piece
                out += piece.split(" ") if self.spaceless else [piece]
        return out

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that are not known yet."""
        cut = [[w for w, _ in self.splitter.pre_tokenize_str(p)] if self.splitter else [p] for p in parts]
        new = list(set(chain.from_iterable(cut)))
        ids = dict(zip(new, self.merges.encode(new)))
        self.known.update((p, tuple(chain.from_iterable(map(ids.__getitem__, words)))) for p, words in zip(parts, cut))

    def encode(self, texts: list[str]) -> list[array]:
        """Token ids of each text."""
        gc.disable()  # millions of small objects in no cycle
        try:
            cut = [self._parts(t) for t in texts]
            if len(self.known) > WORDS:
                self.known = dict(self.plain)
            known = self.known
            self._learn(list({p for c in cut for p in c if p not in known}))
            return [array("i", chain.from_iterable(map(known.__getitem__, c))) for c in cut]
        finally:
            gc.enable()

    def decode(self, ids) -> str:
        """Text of token ids, special tokens included; ids that no token has are left out."""
        n = len(self.names)
        tokens = [self.names[i] for i in ids if i is not None and 0 <= i < n]
        return self.decoder.decode(tokens) if self.decoder else " ".join(tokens)


@lru_cache(maxsize=2)
def _codec(file: str) -> Codec:
    return Codec(file)


def _file(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns of ``docs`` with ``ids_col``, the token ids of each text.

    No special tokens are put in; those that a text spells out get their ids. Null and empty texts
    have no tokens. With ``decoded_col`` the ids are decoded at once in the same pass. Columns with
    these names are replaced. Rows are taken one by one, so repeated rows get the same result.
    """
    file = _file(docs.sparkSession, tokenizer)
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    taken = {f.name.lower() for f in new}
    (text,) = free_name(docs, f"_{ids_col}_of")
    kept = [c for c in docs.columns if c.lower() not in taken]
    rows = docs.select(*kept, docs[text_col].alias(text))
    schema = T.StructType([rows.schema[c] for c in kept] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for start, stop in _slices(texts):
                ids = codec.encode(texts[start:stop])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids]) if ends[-1] else np.zeros(0, np.int32)
                columns = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                if decoded_col:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns of ``rows`` with ``text_col``, the text of the token ids; null and empty ids give an empty text."""
    file = _file(rows.sparkSession, tokenizer)
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for batch in batches:
            texts = pa.array([codec.decode(x or ()) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()], pa.string())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=schema.names)

    source = rows if text_col.lower() == ids_col.lower() else rows.select(*kept)
    return source.mapInArrow(run, schema)
