"""Groups of spelling variants: words one edit apart, and the commoner form of each.

Two words one edit apart differ at one place, the end of their common prefix. So they agree on all
before and on all after an interval that holds the place: the intervals before and after the middle
of the shorter word give two keys, and only words that share a key are compared. A word takes part
in the keys of its own length as the shorter word and of one less as the longer one. Keys with
more than ``GROUP`` words are cut into halves of their interval, again and again; an interval of one
place leaves one or two free letters. So no group grows with the vocabulary, and nothing is left out.

Within a key the words are sorted (from behind, where the shared part is the end), and each word
scans those that follow. The rows of the edit matrix, three cells wide around the diagonal, are kept by depth;
a word starts from the row at its common prefix with the word before it. Where all cells of a row
exceed one edit, all words with that prefix are skipped.

A pair is counted in the one interval that holds its place, so the numbers of pairs and the best
forms of each word are plain sums and extremes over the keys: linear output, whatever the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, whole_groups

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
RATIO = 10  # a form occurs at least so many times as often
DAMAGE = 31  # one run in so many loses a letter
GROUP = 20_000  # words of a key that one task compares
BATCH = 50_000  # rows that a task looks at together
BROADCAST_ROWS = 1_000_000  # keys of groups that are too large, about 20 bytes each

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, shortest: int = SHORTEST) -> Column:
    """Array of the maximal runs of letters of at least so many code points, A-Z in lower case; empty for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, UPPER, LOWER))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the checksum of id and run says so; a null id is an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGE == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """Words and their occurrences: (word, n). Counted per task before the shuffle; repeated rows count each time."""
    run = docs.select(docs[id_col].alias("id"), F.explode(runs(docs[text_col], shortest)).alias("run"))
    words = run.select(damaged(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(words: DataFrame, low: Column, high: Column) -> DataFrame:
    """Add ``low``, ``high`` and ``k``: what the word has outside of places ``low`` to ``high`` of the shorter of ``m`` letters."""
    d = words.withColumns({"low": low.cast("int"), "high": high.cast("int")})
    tail = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    end = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    return d.withColumn("k", F.xxhash64("m", "low", "high", F.substring("word", F.lit(1), F.col("low")), end))


def _groups(words: DataFrame, limit: int) -> Iterator[DataFrame]:
    """Rows of words by key, in rounds; those of keys with too many words come in the next round, cut further."""
    length = F.length("word")
    d = words.withColumn("m", F.explode(F.array(length - 1, length)))
    d = d.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    middle = F.floor(F.col("m") / 2)
    d = _keyed(d, F.when(F.col("half") == 0, 0).otherwise(middle), F.when(F.col("half") == 0, middle).otherwise(F.col("m") + 1)).drop("half")
    while True:
        crowd = d.where(F.col("high") - F.col("low") > 1).groupBy("k").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("k")
        crowd = materialise(crowd, "crowded")
        n = crowd.count()
        if not n:
            yield d
            return
        side = F.broadcast(crowd) if n <= BROADCAST_ROWS else crowd
        yield d.join(side, "k", "left_anti")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        d = materialise(d.join(side, "k", "left_semi"), "crowded-words")
        parts = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("high").alias("b")))
        d = d.withColumn("part", F.explode(parts))
        d = _keyed(d.select("word", "n", "m", "part"), F.col("part.a"), F.col("part.b")).drop("part")


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    return i


def near_in_sorted(words: list[str], shared: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs of places (i, j), i before j, of different sorted words that are one edit apart.

    ``shared`` letters at the front are known to be equal in all of them.
    """
    n = len(words)
    lcp = [0] * (n + 1)
    for j in range(1, n):
        lcp[j] = _common(words[j - 1], words[j])
    # the next word that shares less with the one before it
    less, stack = [n] * (n + 1), []
    for j in range(1, n):
        while stack and lcp[stack[-1]] > lcp[j]:
            less[stack.pop()] = j
        stack.append(j)
    for i in range(n - 1):
        q = words[i]
        size = len(q)
        # rows[d]: edits between the first d letters of a word and the first d - 1, d, d + 1 of q; 2 stands for more.
        # q itself is the word before the first one
        rows = [(1, 0, 1)] * (size + 1)
        j = i + 1
        while j < n:
            w = words[j]
            d = lcp[j]
            if d < shared:
                break
            end = len(w)
            below, on, above = rows[d]
            alive = True
            while d < end:
                c = w[d]
                x = below + (d == 0 or d > size or c != q[d - 1])
                if on < x:
                    x = on + 1
                y = on + (d >= size or c != q[d])
                if above < y:
                    y = above + 1
                if x < y:
                    y = x + 1
                z = above + (d + 1 >= size or c != q[d + 1])
                if y < z:
                    z = y + 1
                d += 1
                below, on, above = x, y, z
                if d < len(rows):
                    rows[d] = (x, y, z)
                else:
                    rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    alive = False
                    break
            if alive:
                k = size - end
                if -1 <= k <= 1 and (below, on, above)[k + 1] == 1:
                    yield i, j
                j += 1
            else:  # all words with these d letters are too far
                j += 1
                while j < n and lcp[j] >= d:
                    j = less[j]


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of each word within the keys: (word, n_near, best_n, best)."""
    for d in whole_groups(parts, ["k"], BATCH):
        keys = d["k"].to_numpy()
        starts = [0, *(1 + (keys[1:] != keys[:-1]).nonzero()[0]).tolist(), len(keys)] if len(keys) else [0]
        words, front = d["word"].tolist(), d["s"].tolist()
        counts, ms, lows, highs = d["n"].tolist(), d["m"].tolist(), d["low"].tolist(), d["high"].tolist()
        found: dict[int, list] = {}
        for a, b in zip(starts, starts[1:]):
            if b - a < 2:
                continue
            m, low, high = ms[a], lows[a], highs[a]
            for i, j in near_in_sorted(front[a:b], max(low, m - high)):
                x, y = words[a + i], words[a + j]
                if len(x) > m and len(y) > m:  # both are the longer word: the key of the next length has them
                    continue
                if not low <= _common(x, y) < high:
                    continue
                for here, there in ((a + i, a + j), (a + j, a + i)):
                    best = (-counts[there], words[there])
                    old = found.get(here)
                    if old is None:
                        found[here] = [1, best]
                    else:
                        old[0] += 1
                        old[1] = min(old[1], best)
        if not found:
            continue
        yield pd.DataFrame({"word": [words[i] for i in found], "n_near": pd.array([v[0] for v in found.values()], "int64"),
                            "best_n": pd.array([-v[1][0] for v in found.values()], "int64"), "best": [v[1][1] for v in found.values()]})


def near(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """Near words of each of the distinct words (word, n): (word, n_near, best_n, best), only words that have any.

    ``best`` is the near word of largest n, the first in code-point order of equals.
    """
    schema = "word string, n_near long, best_n long, best string"
    every = None
    for d in _groups(words, limit):
        # the shared part comes first
        behind = F.col("low") < F.col("m") - F.col("high")
        d = d.withColumn("s", F.when(behind, F.reverse("word")).otherwise(F.col("word")))
        d = d.repartition("k").sortWithinPartitions("k", "s").mapInPandas(_scan, schema)
        every = d if every is None else every.unionByName(d)
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame, hops: int) -> DataFrame:
    """Follow (word, form) to the last: (word, root). No chain has more than ``hops`` links; each round doubles the links followed."""
    d = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(hops, 1))))):
        d = materialise(d, "roots")
        onward = d.select(F.col("word").alias("root"), F.col("root").alias("further"))
        d = d.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return d


def group(words: DataFrame, ratio: int = RATIO, limit: int = GROUP) -> DataFrame:
    """The form and root of each word: (word, form, root, n, n_near, form_n).

    ``words`` are distinct, not null, with their occurrences (word, n); other columns are left
    out. A word's form is its commonest near word (ties: first in code-point order) if that occurs
    ``ratio`` times as often or more, else null; its root is the last form of forms, itself without one.
    ``ratio`` is at least 2, so each form is commoner and a chain has at most log(n) links.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = near(words, limit)
    known = words.unionByName(found.withColumn("n", F.lit(None).cast("long")), allowMissingColumns=True)
    known = known.groupBy("word").agg(*[F.max(c).alias(c) for c in ("n", "n_near", "best_n", "best")])
    has = F.col("best_n") >= ratio * F.col("n")
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"),
                                     F.when(has, F.col("best_n")).alias("form_n")), "variants")
    most, least = known.agg(F.max("n"), F.min("n")).first()
    hops = int(math.log(max(most or 1, 1) / max(least or 1, 1), ratio) + 1e-9)
    last = roots(known.where("form is not null"), hops)
    out = known.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# Reference SQL of ``group(vocabulary(documents))``: words equal without one letter at one place, or equal to a longer word without one.
SQL = f"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
run AS (SELECT doc_id, translate(w, '{UPPER}', '{LOWER}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{LETTERS}{{{SHORTEST},}}')) AS w FROM documents)),
bytes AS (SELECT w, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w))) AS x FROM run),
sums AS (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x), 2), lambda p: CAST('0x' || substr(x, p, 2) AS BIGINT))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM bytes, tab
), words AS (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM sums)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {LEAST}
), cut AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
longer AS MATERIALIZED (SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cut c JOIN words w ON c.rest = w.word),
pairs AS (
  SELECT x.word AS word, y.word AS other, y.n AS n FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
  UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer
), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * w.n THEN other END AS form, CASE WHEN top >= {RATIO} * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain(word, root, k) AS (
  SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT word, last(root ORDER BY k) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
