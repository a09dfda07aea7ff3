"""Counts of edited texts equal counts from scratch."""

import random
import re

from pyspark.sql import functions as F

from riskframe.llm import token_counts as t


def counter(spark):
    return t.Counter(spark)


def random_text(rng):
    return "".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "12", "!", "'s", " the", " word", "漢", "\t", "，", "。", "'", ".", "ж"]) for _ in range(rng.randint(0, 400)))


def test_edits_equal_a_fresh_count(spark):
    rng, count = random.Random(2), counter(spark)
    for _ in range(120):
        text = random_text(rng)
        cut = t.leaves(text, rng.choice([5, 20, 80]))
        assert "".join(cut) == text and sum(map(count, cut)) == (count(text) if text else 0)
        chars, tokens = t.tree([len(x) for x in cut]), t.tree([count(x) for x in cut])
        for _ in range(3):  # edits follow edits
            edits, at = [], 0
            for _ in range(rng.randint(0, 5)):
                start = rng.randint(at, len(text))
                stop = min(len(text), start + rng.choice([0, 0, 1, 4, 30]))
                edits.append((start, stop, random_text(rng)[: rng.choice([0, 1, 3, 20])]))
                at = stop
            want, last = [], 0
            for start, stop, new in sorted(edits):
                want += [text[last:start], new]
                last = stop
            want = "".join(want) + text[last:]
            text, chars, tokens, encoded = t.edit(text, chars, tokens, edits, count)
            assert text == want and chars[1] == len(text) and tokens[1] == (count(text) if text else 0)
            assert all(x[k] == x[2 * k] + x[2 * k + 1] for x in (chars, tokens) for k in range(1, len(x) // 2))


def test_only_touched_regions_are_encoded(spark):
    count = counter(spark)
    text = " ".join(f"word{i}" for i in range(5000))
    cut = t.leaves(text)
    _, _, _, encoded = t.edit(text, t.tree([len(x) for x in cut]), t.tree([count(x) for x in cut]), [(20000, 20004, "new")], count)
    assert 0 < encoded < 3 * t.LEAF


def test_tables(spark):
    count = counter(spark)
    rows = [(1, "call 1234567890 now"), (1, "call 1234567890 now"), (None, None), (2, ""), (3, "x" * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("mine")).withColumn("chars", F.lit(1))
    built = t.build(docs, count)
    edited = t.apply(built.withColumn("edits", t.replace_edits(F.col("text"), r"\d{9,}", "#")), count, "edits")
    got = [(r.doc_id, r.text, r.tree["tokens"][1]) for r in edited.collect()]
    assert sorted(got, key=str) == sorted([(1, "call # now", count("call # now"))] * 2 + [(None, None, 0), (2, "", 0), (3, "x" * 100000, count("x" * 100000))], key=str)
    none = t.apply(built.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,text:string>>")), count, "edits")
    assert none.select(F.max("encoded")).first()[0] == 0
    assert t.build(docs.limit(0), count).count() == 0


def test_text_without_spaces(spark):
    count = counter(spark)
    text = "漢字かな，カナ。abc;12!" * 4000
    cut = t.leaves(text)
    assert len(cut) > 40 and max(map(len, cut)) < 1.2 * t.LEAF and sum(map(count, cut)) == count(text)
    _, _, _, encoded = t.edit(text, t.tree([len(x) for x in cut]), t.tree([count(x) for x in cut]), [(30000, 30002, "x")], count)
    assert 0 < encoded < 3 * t.LEAF


def test_recount(spark):
    count = counter(spark)
    big = "call 1234567890 now, " * 250000  # 5 MB
    rows = [(1, "call 1234567890 now"), (1, "call 1234567890 now"), (None, None), (2, ""), (3, "x" * 60000), (4, big), (5, "漢字，" * 20000 + "123456789")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("n_tokens", "text_to_count", "edited")])
    out = t.recount(docs, count, r"\d{9,}", "#", edited_col="edited")
    assert out.columns == ["doc_id", "text", "text_to_count", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded", "edited"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        edited = re.sub(r"\d{9,}", "#", r.text or "")
        assert (r.n_tokens, r.n_tokens_edited) == (count(r.text) if r.text else 0, count(edited) if edited else 0)
        assert r.edited == edited and r.n_edits == len(re.findall(r"\d{9,}", r.text or ""))
    assert {r.n_chars_encoded for r in found if r.doc_id == 5} < set(range(1, 3 * t.LEAF))
    assert t.recount(docs.limit(0), count, "x", "y").count() == 0
