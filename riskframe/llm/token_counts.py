"""Token counts that follow edits.

A text is cut into leaves of about ``LEAF`` characters, only where no pre-token of the tokenizer ever
reaches across: at single spaces between two non-spaces, and between a letter or digit and a
punctuation mark, so that text without spaces has leaves too. So the text's tokens are the sum of
its leaves' tokens. A run of letters alone is one pre-token and one leaf, however long. A binary tree over the leaves holds, per subtree, characters and
tokens. An edit finds the leaves that it touches by the characters, with one more character on
either side as context; only these are encoded again, and the sums above them updated.

The vocabulary is read once by the driver and broadcast: its size is fixed by its file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 1000

# Code points that are letters or digits, and marks that are neither, in every version of Unicode; a few scripts.
_WORD = r"[0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u0391-\u03A1\u03B1-\u03C9\u0410-\u044F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]"
_MARK = r"[!-/:-@\[-`{-~\u3001\u3002\u3008-\u3011\uFF01-\uFF0F\uFF1A-\uFF20]"
_CUT = re.compile(rf"(?<=\S) (?=\S)|(?<={_WORD})(?={_MARK})")
_TREE = "struct<chars: array<int>, tokens: array<int>>"
_EDITS = "array<struct<start: int, stop: int, text: string>>"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class Counter:
    """Counts tokens in a task; the tables travel as a broadcast."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            self.ranks = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def __call__(self, text: str) -> int:
        return len(_encoding(self.ranks.value, self.pattern).encode_ordinary(text))


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces that are encoded on their own; none for an empty text."""
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


def tree(values: list[int]) -> list[int]:
    """Sums of a complete binary tree: node k over nodes 2k and 2k + 1, leaves last."""
    width = 1
    while width < len(values):
        width *= 2
    out = [0] * width + values + [0] * (width - len(values))
    for k in range(width - 1, 0, -1):
        out[k] = out[2 * k] + out[2 * k + 1]
    return out


def _leaf_at(chars: list[int], place: int) -> int:
    """Number of the leaf with the character at ``place``, clipped to the text."""
    width = len(chars) // 2
    place = max(0, min(place, chars[1] - 1))
    k = 1
    while k < width:
        k *= 2
        if place >= chars[k]:
            place -= chars[k]
            k += 1
    return k - width


def _set(sums: list[int], leaf: int, value: int) -> None:
    k = len(sums) // 2 + leaf
    change = value - sums[k]
    while k and change:
        sums[k] += change
        k //= 2


def edit(text: str, chars: list[int], tokens: list[int], edits: list[tuple[int, int, str]], count) -> tuple[str, list[int], list[int], int]:
    """Apply edits (start, stop, new text) to a text and its tree; also returns the characters encoded.

    Positions refer to the text as it was. Edits are taken in order of position; one that overlaps
    the one before it is left out.
    """
    chars, tokens = list(chars), list(tokens)
    width = len(chars) // 2
    starts = [0]
    for n in chars[width:]:
        starts.append(starts[-1] + n)
    regions: list[list] = []  # first leaf, last leaf, edits
    end = 0
    for start, stop, new in sorted(edits):
        start, stop = max(0, min(start, len(text))), max(0, min(stop, len(text)))
        if start < end or stop < start:
            continue
        end = stop
        first, last = (0, 0) if not text else (_leaf_at(chars, start - 2), _leaf_at(chars, stop + 1))
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(last, regions[-1][1])
            regions[-1][2].append((start, stop, new))
        else:
            regions.append([first, last, [(start, stop, new)]])
    out, at, encoded = [], 0, 0
    for first, last, changes in regions:
        piece, here = [], starts[first]
        for start, stop, new in changes:
            piece += [text[here:start], new]
            here = stop
        piece = "".join([*piece, text[here : starts[last + 1]]])
        out += [text[at : starts[first]], piece]
        at = starts[last + 1]
        for leaf in range(first, last + 1):
            _set(chars, leaf, len(piece) if leaf == first else 0)
            _set(tokens, leaf, count(piece) if leaf == first and piece else 0)
        encoded += len(piece)
    return "".join([*out, text[at:]]), chars, tokens, encoded


def _build_udf(count: Counter, size: int):
    def build(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            cut = [leaves(t or "", size) for t in part]
            yield pd.DataFrame({"chars": [tree([len(x) for x in c]) for c in cut], "tokens": [tree([count(x) for x in c]) for c in cut]})

    return F.pandas_udf(build, _TREE)


def _edit_udf(count: Counter):
    def apply(parts: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, trees, edits in parts:
            rows = []
            for t, c, k, e in zip(texts, trees["chars"], trees["tokens"], edits):
                todo = [] if e is None else [(x["start"], x["stop"], x["text"] or "") for x in e]
                text, chars, tokens, encoded = edit(t or "", list(c), list(k), todo, count)
                rows.append((text if t is not None or text else None, {"chars": chars, "tokens": tokens}, encoded))
            yield pd.DataFrame(rows, columns=["text", "tree", "encoded"])

    return F.pandas_udf(apply, f"struct<text: string, tree: {_TREE}, encoded: int>")


def replace_edits(text: Column, pattern: str, new: str) -> Column:
    """Edits that replace every match of a Python pattern by ``new``."""
    compiled = re.compile(pattern)

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[{"start": m.start(), "stop": m.end(), "text": new} for m in compiled.finditer(t or "")] for t in part], dtype=object)

    return F.pandas_udf(find, _EDITS)(text)


def recount(docs: DataFrame, count: Counter, pattern: str, new: str, text_col: str = "text", edited_col: str | None = None, leaf: int = LEAF) -> DataFrame:
    """All columns of ``docs`` and the counts before and after every match of a pattern is replaced by ``new``.

    Adds n_tokens, n_edits, n_tokens_edited and n_chars_encoded (again, for the edits), and the edited text only where a
    name for it is given; columns with these names are replaced. One text and its tree are held at
    a time. Null and empty texts have no tokens; an edited null text is empty.
    """
    compiled = re.compile(pattern)
    names = ["n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"]
    added = [T.StructField(n, T.LongType()) for n in names] + ([T.StructField(edited_col, T.StringType())] if edited_col else [])
    taken = {f.name.lower() for f in added}
    kept = [c for c in docs.columns if c.lower() not in taken]
    (own,) = free_name(docs, "text_to_count")
    rows = docs.select(*kept, F.col(text_col).alias(own))
    schema = T.StructType([rows.schema[c] for c in kept] + added)

    def one(text: str) -> tuple:
        cut = leaves(text, leaf)
        chars, tokens = tree([len(x) for x in cut]), tree([count(x) for x in cut])
        edits = [(m.start(), m.end(), new) for m in compiled.finditer(text)]
        if not edits:
            return tokens[1], 0, tokens[1], 0, text
        after, _, changed, encoded = edit(text, chars, tokens, edits, count)
        return tokens[1], len(edits), changed[1], encoded, after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(batch.schema.get_field_index(own)), []
            for t in texts:
                found = one(t.as_py() or "")
                out.append(found if edited_col else found[:4])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            types = [pa.int64()] * 4 + [pa.string()]
            columns += [pa.array(list(values), kind) for values, kind in zip(zip(*out), types)] if out else [pa.array([], kind) for kind in types[: len(added)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def total(tree_col: str) -> Column:
    """Tokens of the whole text: the sum at the root."""
    return F.get(F.col(f"{tree_col}.tokens"), F.lit(1)).cast("long")


def build(docs: DataFrame, count: Counter, text_col: str = "text", tree_col: str = "tree", leaf: int = LEAF) -> DataFrame:
    """All columns of ``docs`` and the tree of each text; null and empty text have no tokens."""
    return docs.withColumn(tree_col, _build_udf(count, leaf)(F.col(text_col)))


def apply(docs: DataFrame, count: Counter, edits_col: str, text_col: str = "text", tree_col: str = "tree", encoded_col: str = "encoded") -> DataFrame:
    """Texts and trees after their edits, and the characters that were encoded again.

    Null edits and empty lists change nothing; a null text is edited as empty text and stays null
    if nothing is put in.
    """
    new = _edit_udf(count)(F.col(text_col), F.col(tree_col), F.col(edits_col))
    rows = docs.withColumn("_edited", new)
    return rows.withColumns({text_col: F.col("_edited.text"), tree_col: F.col("_edited.tree"), encoded_col: F.col("_edited.encoded")}).drop("_edited")
