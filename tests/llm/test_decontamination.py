"""Template windows: verbatim, re-parameterised and inconsistent questions, odd inputs."""

from pyspark.sql import functions as F

from riskframe.llm import decontamination as d

ITEM = "Mary walks 12 km to the old market and carries 12 apples while Peter rides 7 miles along the river every morning"
PLAIN = "the quiet lantern above seven narrow doors was painted green before autumn and nobody remembered why it had happened"


def found(spark, docs, items=((1, ITEM), (2, PLAIN)), **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.changed for r in d.leaks(df, bench, **options).collect()}


def test_templates(spark):
    again = ITEM.replace("12", "35").replace("Peter", "Oscar").replace("7", "4").replace("miles", "km")
    broken = ITEM.replace("12 km", "35 km").replace("12 apples", "90 apples")
    docs = [
        (1, "Some words before. " + ITEM + ". Some words after."), (2, "He said that " + again + " and left"), (3, broken), (4, PLAIN.upper() + "!!"),
        (5, "said that " + PLAIN.capitalize() + " so it goes"), (6, " ".join(PLAIN.split()[:7])), (7, "nothing of the kind at all stands in this text of many words here"),
        (8, None), (9, ""), (10, ITEM + " " + ITEM),
    ]
    got = found(spark, docs)
    assert got == {(1, 1): False, (2, 1): True, (4, 2): False, (5, 2): False, (10, 1): False}
    assert found(spark, docs, broadcast_rows=0) == got


def test_short_items_nulls_and_repeats(spark):
    items = [(1, "what colour is the sky today"), (2, "too short"), (3, None), (None, PLAIN), (4, ""), (5, PLAIN), (5, PLAIN)]
    docs = [(1, "I ask: what colour is the sky today?"), (1, "I ask: what colour is the sky today?"), (None, PLAIN), (2, "too short")]
    assert found(spark, docs, items) == {(1, 1): False, (None, 5): False}


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, PLAIN)], ()) == {}
    docs = spark.createDataFrame([(1, PLAIN), (2, "clean words of no interest to anyone in particular today"), (3, None)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(1).alias(n) for n in ("k1", "k2", "i", "h", "item_id", "item", "w", "words", "slot")])
    bench = spark.createDataFrame([(7, PLAIN)], "item_id long, text string")
    kept = d.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    long = " ".join(f"w{i}" for i in range(30000)) + " " + PLAIN
    assert found(spark, [(1, long)]) == {(1, 2): False}


def test_number_dense_items(spark):
    dense = "what is 3 kg plus 4 kg plus 5 kg in g today"
    one = "add 3 kg 4 kg and 5 kg"
    docs = [
        (1, f"They asked: {dense}?"), (2, "They asked: what is 9 kg plus 2 kg plus 7 kg in g today?"), (3, f"Now {one} please"), (4, "2 kg plus 7 kg plus 5 kg"),
        (5, "what is 3 kg plus 4 kg plus 5 kg in bed today"), (6, "1 kg 2 kg 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg"),
    ]
    got = found(spark, docs, ((1, dense), (2, one)))
    assert got == {(1, 1): False, (2, 1): True, (3, 2): False}
    assert found(spark, docs, ((1, dense), (2, one)), broadcast_rows=0) == got


def test_names_at_any_place_and_in_any_case(spark):
    tom = "Tom has 3 apples. Tom buys 4 more. Tom eats 2. How many apples does Tom have?"
    short = "Is it true: Tom owns 3 red boats near Rome"
    docs = [
        (1, tom.replace("Tom", "Anna")), (2, "He asked: " + tom.replace("Tom", "Anna").replace("4", "9")), (3, tom.replace("Tom", "Anna", 2)), (4, ITEM.lower()), (5, ITEM.upper()),
        (6, ITEM.title()), (7, ITEM.lower().replace("7", "9")), (8, short.replace("Tom", "Anna")), (9, short.upper()), (10, "Tom Has Many Apples And Anna Buys A Few"),
    ]
    got = found(spark, docs, ((1, ITEM), (2, tom), (3, short)))
    assert got == {(1, 2): True, (2, 2): True, (4, 1): False, (5, 1): False, (6, 1): False, (7, 1): True, (8, 3): True, (9, 3): False}
