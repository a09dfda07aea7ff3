"""Quality rules, line first: bad lines go, then documents that lost too much text.

Each line is judged alone by three rules:

* punctuation: more than one mark such as ``!``, ``#`` or ``*`` for two words, or a long line
  that breaks off at a comma or dash;
* navigation: at least two separators such as ``|`` and one for every four words;
* boilerplate: a licence, copyright or policy phrase.

A document is kept if it passes the base limits on length and repeated words and its failing
lines hold at most ``MAX_LOSS`` percent of its word characters. All of it is expressed on the
columns of a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words in repeated three-word windows
MAX_LOSS = 30  # percent of word characters in failing lines

# What the line rules look for.
MARKS = r"[!#*$%&<>=~^_\\]"
SEPARATORS = r"[|»›·•]"
SYMBOLS = r"[#*$%&|<>]"
BROKEN = r"[,\-–—][ \t\r]*$"
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright (c)", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "cc by", "creative commons", "public domain",
)
LONG_LINE = 10


def _matches(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def failing(line: Column, n_words: Column) -> Column:
    """Name of the rule that a line fails, null if none."""
    lower = F.lower(line)
    phrase = lower.contains(BOILERPLATE[0])
    for p in BOILERPLATE[1:]:
        phrase = phrase | lower.contains(p)
    marks, separators = _matches(line, MARKS), _matches(line, SEPARATORS)
    return (
        F.when(n_words == 0, F.lit(None).cast("string"))
        .when((marks >= 3) & (2 * marks > n_words), "punctuation")
        .when((n_words >= LONG_LINE) & line.rlike(BROKEN), "punctuation")
        .when((separators >= 2) & (4 * separators >= n_words), "navigation")
        .when(phrase, "boilerplate")
    )


def repeated_words(w: Column) -> tuple[Column, Column, Column, Column]:
    """Four steps to the number of words in three-word windows found twice or more.

    To be computed one column after the other: word hashes; windows (hash, position) in hash order from the
    words; start positions of windows with an equal neighbour from those; the words they cover.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = F.sort_array(F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 2, F.lit(0))), lambda h, i: F.struct(
        F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)).alias("h"), i.alias("i"))))
    same = F.transform("_windows", lambda x, k: F.when(
        (x["h"] == F.get("_windows", k - 1)["h"]) | (x["h"] == F.get("_windows", k + 1)["h"]), x["i"]))
    starts = F.sort_array(F.array_compact(same))
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return hashes, windows, starts, covered


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: sizes, repeats, ``lines`` with the rule each fails, and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, lost_chars, lines (array of line and rule). Null text has no words and fails the base
    limits, as does empty text. Rows with equal ids are judged one by one; other columns are
    not read.
    """
    hashes, windows, starts, covered = repeated_words(F.col("_words"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.withColumn("_words", words(F.col("_text"))).withColumn("_hashes", hashes).withColumn("_windows", windows).withColumn("_starts", starts)
    line = F.transform(F.split("_text", "\n"), lambda x: F.struct(
        x.alias("line"), F.size(F.array_remove(F.split(x, SPACES), "")).alias("n"), F.length(F.regexp_replace(x, SPACES, "")).alias("chars")))
    d = d.withColumn("_lines", F.filter(line, lambda x: x["n"] > 0))
    d = d.withColumn("lines", F.transform("_lines", lambda x: F.struct(
        x["line"].alias("line"), x["chars"].alias("chars"), failing(x["line"], x["n"]).alias("rule"))))
    lost = F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(x["rule"].isNotNull(), x["chars"]).otherwise(0))
    d = d.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        _matches(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(F.transform("_lines", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), lost.cast("long").alias("lost_chars"), "lines",
    )
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOSS * F.col("word_chars")))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept documents with their good lines only: doc_id and text."""
    good = F.filter("lines", lambda x: x["rule"].isNull())
    return measure(docs, id_col, text_col).where("kept").select(
        "doc_id", F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("text"))


REPORT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]

_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
c AS (SELECT r, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
             length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
             length(line) - length(regexp_replace(line, '[!#*$%&<>=~^_\\\\]', '', 'g')) AS marks,
             length(line) - length(regexp_replace(line, '[|»›·•]', '', 'g')) AS seps FROM l),
j AS (SELECT r, sum(CASE WHEN (marks >= 3 AND 2 * marks > n) OR (n >= {LONG_LINE} AND regexp_matches(line, '[,\\-–—][ \\t\\r]*$'))
                           OR (seps >= 2 AND 4 * seps >= n) OR {_PHRASES} THEN chars ELSE 0 END) AS lost,
             count(*) - count(DISTINCT line) AS dup FROM c WHERE n > 0 GROUP BY r),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1),
p AS (SELECT r, count(DISTINCT i + o) AS covered FROM s, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
      FROM d JOIN w USING (r) LEFT JOIN j USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOSS} * word_chars AS kept FROM b
"""
