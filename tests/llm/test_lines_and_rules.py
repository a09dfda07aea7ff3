"""Line windows and line rules on small and odd inputs."""

import random

from pyspark.sql import functions as F

from riskframe.llm import line_dedup, quality_rules


def brute(docs, width=3):
    """docs: (id, text), ids distinct."""
    lines = {}
    for i, t in docs:
        split = (t or "").split("\n")
        lines[i] = (split, [k for k, x in enumerate(split) if x.strip(" \t\r")])
    first, gone = {}, {i: set() for i, _ in docs}
    for i, _ in sorted(docs):
        split, some = lines[i]
        for j in range(len(some) - width + 1):
            w = tuple(split[k].strip(" \t\r") for k in some[j : j + width])
            if w not in first:
                first[w] = (i, j)
                continue
            d, f = first[w]
            gone[i] |= {some[j + o] for o in range(width) if d != i or j + o >= f + width}
    return {i: ("\n".join(x for k, x in enumerate(lines[i][0]) if k not in gone[i]) if t is not None else None, len(gone[i])) for i, t in docs}


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", " a ", "", "d\r", "e"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a\na\na\na\na\na"), (103, "only\ntwo")]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute(docs)
    assert {r.doc_id: (r.text, r.n_removed) for r in got.collect()} == want


def test_line_odd_inputs(spark):
    text = "x1\nx2\nx3\nx4"
    rows = [(None, text), (5, text), (5, text), (5, "x1\nx2\nx3\nother"), (1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(7).alias(n) for n in ("k1", "k2", "positions", "removed", "all", "count", "a", "b", "j")])
    got = line_dedup.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == 5
    by = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    # the rows of document 5 are one document; of its two texts one comes first
    assert (None, "", 4) in by and (1, "y", 0) in by
    assert sorted(x for x in by if x[0] == 5) in (
        [(5, "", 3)] * 0 + sorted([(5, text, 0), (5, text, 0), (5, "other", 3)]), sorted([(5, "x4", 3), (5, "x4", 3), (5, "x1\nx2\nx3\nother", 0)]))
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    long = "\n".join(f"line {i}" for i in range(20000))
    twice = line_dedup.dedup(spark.createDataFrame([(1, long), (2, long + "\nend")], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in twice.collect()} == {1: 0, 2: 20000}


def rules(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in quality_rules.measure(docs).orderBy("doc_id").collect()]


def test_rules(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    nav = "Home | About | News | Contact | Help | Login"
    got = rules(spark, prose, prose + "\n" + nav, " ".join(["buy!!", "now!!"] + [f"w{i}!!" for i in range(60)]), "short text.", None, "",
                prose + "\nAll rights reserved.", "a b c " * 40, nav * 3 + "\n" + prose[:40])
    assert [r.kept for r in got] == [True, True, False, False, False, False, True, False, False]
    assert [r.base_failed for r in got] == [False, False, False, True, True, True, False, True, True]
    assert [x["rule"] for x in got[1]["lines"]] == [None, "navigation"] and got[6]["lines"][1]["rule"] == "boilerplate"
    assert got[2]["lines"][0]["rule"] == "punctuation"
    assert (got[7].n_words, got[7].n_repeat_words) == (120, 120)
    assert (got[4].n_words, got[4].n_dup_lines, got[4].word_chars) == (0, 0, 0)


def test_repeats_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["x " * 5000]
    for r, t in zip(rules(spark, *texts), texts):
        w, seen, covered = t.split(), {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered |= {i + o for i in at for o in range(3)}
        assert r.n_repeat_words == len(covered)


def test_clean_and_odd_columns(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, prose + "\nHome | About | News | Help", "x")], "doc_id long, text string, lines string").withColumn("_words", F.lit(1))
    assert [r.text for r in quality_rules.clean(docs).collect()] == [prose]
    assert quality_rules.measure(docs.limit(0)).count() == 0
