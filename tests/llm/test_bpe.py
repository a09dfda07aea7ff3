"""Token ids and decoded texts equal the tokenizers library's; guesses are verified pair by pair."""

import hashlib
import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "the", "ing", "aaaa", "ll", "'s", "'ll", " ", "\n", "É", "ß", "İ", "Σς", "漢", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "1", "23",
          "!!", "</w>", "\x00", "é", " ", "ana", "nan", "ſt", " ", "\x85"]


def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def test_texts_equal_the_library(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * k for k in range(1, 200)] + ["".join(rng.choice("abn") for _ in range(300)) for _ in range(300)] + ["ha" * 3000, "x" * 20000]
    texts += ["x" + chr(k) + "y" + chr(k) * 2 for k in range(0x3100)]
    codec, lib = bpe.Codec(open(bpe.TOKENIZER).read()), library()
    assert codec.simple and codec.spaceless and codec.merges.sound and codec.merges.whole.all()
    for mine, other in zip(codec.encode(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert list(mine) == other.ids
        assert codec.decode(mine) == lib.decode(other.ids, skip_special_tokens=False)


def test_verification_is_exact():
    """A guess passes the pair checks if and only if exact merging gives the same tokens."""
    codec = bpe.Codec(open(bpe.TOKENIZER).read())
    m, rng = codec.merges, random.Random(3)
    words = list({"".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 14))) for _ in range(4000)})
    same = [m.guess(w) == m.exact(w) for w in words]
    assert 0.1 < sum(same) / len(same) < 0.9
    merged, plain = [], m.exact
    m.exact = lambda w: merged.append(w) or plain(w)
    assert m.encode(words) == [plain(w) for w in words]
    assert sorted(merged) == sorted(w for w, s in zip(words, same) if not s)


def test_other_vocabularies():
    """Merges made in an odd order are never trusted; unknown symbols are left out."""
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa"])}
    for merges in (["a b", "b c", "ab c", "a bc"], ["ab c", "a b", "b c"], ["a a", "a b", "b c", "ab c"]):
        m = bpe.Merges({t: i for t, i in vocab.items()}, merges, "")
        names = {i: t for t, i in vocab.items()}
        for word in ("abc", "aabc", "abcabc", "bcab", "aaab", "xabc", "x", "aaaaa"):
            assert m.encode([word])[0] == m.exact(word)
            assert "".join(names[i] for i in m.exact(word)) == word.replace("x", "")


def test_tables(spark):
    rows = [(1, "Hello, World 42"), (1, "Hello, World 42"), (None, None), (2, ""), (3, "long " * 50000), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("ids", "IDS2", "decoded", "_ids_of", "words")])
    out = bpe.encode(docs, decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "IDS2", "_ids_of", "words", "ids", "decoded"]
    lib = library()
    for r in out.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False) and r.words == 1
    assert out.count() == len(rows)
    back = bpe.decode(bpe.encode(docs), text_col="words")
    assert {(r.text, r.words) for r in back.collect()} == {(r.text, r.decoded) for r in out.collect()}
    assert bpe.encode(docs.limit(0)).count() == 0 and bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([320, 49407, 10**9, -1, None],)], "ids array<int>")
    assert {r.text for r in bpe.decode(odd).collect()} == {"", "a</w> <|endoftext|>"}


def test_query(spark):
    lib = library()
    got = {r.doc_id: r for r in queries.QUERIES["op12_speculative_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids) and mine.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
