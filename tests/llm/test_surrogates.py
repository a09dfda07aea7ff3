"""Surrogates: types, formats, coreference, distinctness, odd inputs."""

import re

from pyspark.sql import functions as F

from riskframe.llm import surrogates as s


def replaced(spark, *texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in s.replace(docs, **options).orderBy("doc_id").collect()]


def luhn(n):
    d = [int(c) for c in reversed(n)]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_types_formats_and_coreference(spark):
    texts = [
        "Call Mrs. Anna Schmidt at +1 (017) 555-7713 or +1.017.555.7713.",
        "MRS X, Mrs. Anna Schmidt; JOHN.DOE@MAIL.EXAMPLE.COM = john.doe@mail.example.com",
        "card 4111 1111 1111 1111, 4111-1111-1111-1111, plain 4432507379035540", "ip 53.224.140.246, token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\"",
        "Herr Иванов и Mme Мария Петрова", "IBAN DE89 3704 0044 0532 0130 00; DE89370400440532013000", "secret: 'abCD-12345xyz' 078-05-1120", "Version 2.0 of 1.2.3 costs 12,50 on page 1234",
    ]
    out = replaced(spark, *texts)
    name = re.search(r"Mrs\. (\w+) (\w+)", out[0])
    assert name[0] in out[1] and name[1] in s.GIVEN["female"]["latin"] and "Schmidt" not in out[0]
    a, b = re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", out[0])[0], re.search(r"\d\.\d{3}\.\d{3}\.\d{4}", out[0])[0]
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    mails = re.findall(r"\S+@\S+", out[1])
    assert mails[0].lower() == mails[1] and mails[0].isupper() and mails[1].endswith(".com") and "john" not in mails[1]
    cards = re.search(r"card (.*), (.*), plain (\d+)", out[2])
    assert cards[1].replace(" ", "-") == cards[2] and luhn(cards[2].replace("-", "")) % 10 == 0 and len(cards[3]) == 16 and cards[3] != "4432507379035540"
    assert re.fullmatch(r'ip \d+\.\d+\.\d+\.\d+, token = "[0-9a-f]{40}"', out[3]) and "53.224" not in out[3] and "2abc" not in out[3]
    assert re.fullmatch(r"Herr [А-Яа-я]+ и Mme (\w+) [А-Яа-я]+", out[4])[1] in s.GIVEN["female"]["cyrillic"]
    ibans = re.search(r"IBAN (.*); (.*)", out[5])
    assert ibans[1].replace(" ", "") == ibans[2] and ibans[2].startswith("DE") and ibans[2] != "DE89370400440532013000"
    assert "abCD" not in out[6] and re.fullmatch(r"secret: '[a-z]{2}[A-Z]{2}-\d{5}[a-z]{3}' \d{3}-\d{2}-\d{4}", out[6])
    assert out[7] == texts[7]
    assert out == replaced(spark, *texts) and out != replaced(spark, *texts, key="another")


def test_collisions_are_drawn_again(spark):
    entities = spark.createDataFrame([("secret", c) for c in "012345"] + [("secret", "x")], "kind string, identity string")
    rows = s._surrogates(entities, "k").collect()
    made = [r.surrogate for r in rows]
    assert len(rows) == 7 and len(set(made)) == 7 and not set(made) & set("012345x")


def test_short_names_do_not_run_out(spark):
    names = [("male", c + v) for c in "bcdfghjklmnpqrstvwxz" for v in "aeiou"]
    mails = [("mail", f"{c}@{d}.org") for c in "aeiou" for d in "aeiou"]
    rows = [*names, *mails, ("female", "արամ"), ("secret", "$%&!$%&!")]
    made = {(r.kind, r.identity): r.surrogate for r in s._surrogates(spark.createDataFrame(rows, "kind string, identity string"), "k").collect()}
    assert set(made) == set(rows) and len({(k, v) for (k, _), v in made.items()}) == len(rows)
    assert not {(k, v) for (k, _), v in made.items()} & set(rows)
    assert not set("արմ") & set(made["female", "արամ"]) and "$" not in made["secret", "$%&!$%&!"]
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.org", v) for (k, _), v in made.items() if k == "mail")


def test_odd_inputs(spark):
    assert replaced(spark, None, "", " ", "no data here") == [None, "", " ", "no data here"]
    docs = spark.createDataFrame([(1, "a@b.org"), (1, "a@b.org"), (None, "a@b.org and 10.1.2.3"), (2, None)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(1).alias(n) for n in ("k1", "k2", "by", "surfaces", "surface", "kind")])
    got = s.replace(docs)
    assert got.columns == [*docs.columns, "n_replaced"] and sorted(r.n_replaced for r in got.collect()) == [0, 1, 1, 2]
    assert len({re.match(r"\S+", r.text)[0] for r in got.collect() if r.text}) == 1
    assert s.replace(docs.limit(0)).count() == 0
    long = "word " * 40000 + "mail x.y@example.org " * 50
    out = replaced(spark, long)[0]
    assert len(out) == len(long) and "x.y@example" not in out
