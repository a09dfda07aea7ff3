"""Line dedup by overlapping three-line windows.

Three consecutive non-blank lines make a window. A window that occurs anywhere a second time is
repeated text: its first occurrence, by document id (null last) and position, stays; the lines
of every later occurrence go. Later occurrences overlap, so the positions they cover are merged
per document. Where a later occurrence overlaps the first one of the same window, the first one's
lines stay.

Windows travel as hashes of 128 bits. The first occurrence is a grouped minimum with partial
aggregation and the later ones are found by a join on the hash, so a window in a third of all
documents is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_keys, free_name

WINDOW = 3


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(text: Column) -> Column:
    """Non-blank lines as (i, a, b): line number and two hashes of the stripped line."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), _stripped(x).alias("line")))
    return F.transform(F.filter(every, lambda x: x["line"] != ""), lambda x: F.struct(
        x["i"].alias("i"), F.xxhash64(F.lit(1), x["line"]).alias("a"), F.xxhash64(F.lit(2), x["line"]).alias("b")))


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """One row per window: doc_id, k1, k2 (the document), j (number of its first non-blank line), a, b."""
    text = F.col(text_col)
    k1, k2 = doc_keys(F.col(id_col), text)
    d = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), _lines(text).alias("lines"))
    d = d.where(F.size("lines") >= width)

    def window(_, j: Column) -> Column:
        at = [F.get("lines", j + o) for o in range(width)]
        return F.struct(j.alias("j"), F.xxhash64(*[x["a"] for x in at]).alias("a"), F.xxhash64(F.lit(2), *[x["b"] for x in at]).alias("b"))

    starts = F.slice("lines", 1, F.size("lines") - (width - 1))
    return d.select("doc_id", "k1", "k2", F.explode(F.transform(starts, window)).alias("w")).select("doc_id", "k1", "k2", "w.j", "w.a", "w.b")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Per document with repeated windows: k1, k2 and ``positions``, the non-blank lines to remove."""
    w = windows(docs, id_col, text_col, width)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "j")
    firsts = w.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("final")).where(F.col("first") < F.col("final"))
    same = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    later = w.join(firsts.select("a", "b", "first"), ["a", "b"]).where(~(same & (F.col("j") == F.col("first.j"))))
    start = F.when(same, F.greatest(F.col("j"), F.col("first.j") + width)).otherwise(F.col("j"))
    spans = later.select("k1", "k2", F.explode(F.sequence(start, F.col("j") + (width - 1))).alias("p"))
    return spans.groupBy("k1", "k2").agg(F.collect_set("p").alias("positions"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of the text, and two counts.

    Null text stays null with 0 lines; empty text, blank lines and texts of fewer than ``width``
    non-blank lines stay as they are. Rows with the same id and text are one document and lose the
    same lines; documents with the same id and other texts are ordered by a hash of the text.
    """
    k1, k2, p = free_name(docs, "k1", "k2", "positions")
    gone = covered(docs, id_col, text_col, width).withColumnsRenamed({"k1": k1, "k2": k2, "positions": p})
    text = F.col(text_col)
    keys = doc_keys(F.col(id_col), text)
    rows = docs.withColumns({k1: keys[0], k2: keys[1]}).join(gone, [k1, k2], "left")
    lines = F.split(text, "\n")
    numbers = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), _stripped(x).alias("line"))), lambda x: x["line"] != ""), lambda x: x["i"])
    removed, all_, count = free_name(docs, "removed", "all", "count")
    rows = rows.withColumn(all_, numbers).withColumn(removed, F.transform(p, lambda o: F.get(all_, o)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    rows = rows.withColumn(count, F.when(text.isNull(), 0).otherwise(F.size(lines)))
    rows = rows.withColumn(all_, F.when(F.col(p).isNotNull(), kept)).withColumn(p, lines)
    rows = rows.withColumn(text_col, F.when(F.col(all_).isNull(), text).otherwise(F.array_join(F.transform(all_, lambda i: F.get(p, i)), "\n")))
    return rows.select(*docs.columns, F.col(count).cast("long").alias(n_lines), F.when(F.col(removed).isNull(), 0).otherwise(F.size(removed)).cast("long").alias(n_removed))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY r ORDER BY i) AS j
      FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT x.r, x.doc_id, x.j, x.line || chr(10) || y.line || chr(10) || z.line AS w
      FROM n x JOIN n y ON x.r = y.r AND y.j = x.j + 1 JOIN n z ON x.r = z.r AND z.j = x.j + 2),
f AS (SELECT *, first_value(r) OVER o AS fr, first_value(j) OVER o AS fj FROM w WINDOW o AS (PARTITION BY w ORDER BY doc_id, j)),
c AS (SELECT DISTINCT r, j + o AS j FROM f, (SELECT unnest(range({WINDOW})) AS o)
      WHERE (r <> fr OR j <> fj) AND (r <> fr OR j + o >= fj + {WINDOW})),
g AS (SELECT n.r, n.i FROM n JOIN c ON n.r = c.r AND n.j = c.j)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text,
       count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed
FROM l LEFT JOIN g ON l.r = g.r AND l.i = g.i GROUP BY l.r, l.doc_id
"""
