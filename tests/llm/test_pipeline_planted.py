"""Planted documents: what every stage keeps equals plain Python versions of the rules."""

import random
import re

import corpus_pipeline as p
import pytest

VOCABULARY = {
    "en": "the of and that with this house water think river stone story reads calm people under evening before garden window letter morning quiet always bridge",
    "de": "der die und nicht mit auch haus wasser denken fluss stein lesen ruhig leute unter abend vorher garten fenster brief morgen immer brücke zwischen",
    "fr": "le les et que avec aussi maison eau penser fleuve pierre histoire calme gens sous soir avant jardin fenêtre lettre matin toujours pont entre",
    "es": "el los y que con también casa agua pensar río piedra historia calma gente bajo tarde antes jardín ventana carta mañana siempre puente entre",
}
ITEM = "Mary walks 12 km to the old market and carries 9 apples while the others wait 7 hours along the river every morning"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = SPACE.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)

    def line(lang, n=14):
        return " ".join(rng.choices(VOCABULARY[lang].split(), k=n))

    rows = []
    for k in range(80):
        lang = list(VOCABULARY)[k % 4]
        rows.append((k, "\n".join(line(lang) for _ in range(6)), lang, f"src{k % 3}"))
    passage = "\n".join(line("en") for _ in range(3))
    rows += [(1000, None, "en", "src0"), (1001, "123 456 !!", None, "src0"), (1002, "", "en", None)]
    rows += [(2000, f"{line('en')}\n{passage}\n{line('en')}", "en", "src1"), (2001, f"{line('en')}\n{passage}\n{line('en')}", "en", "src1"), (2002, passage, "en", "src2")]
    words = [line("de", 90).split(), line("fr", 80).split()]
    changed = list(words[0])
    changed[40] = "anders"
    rows += [(3001, " ".join(words[0]), "de", "src0"), (3000, " ".join(changed), "de", "src0"), (3002, " ".join(words[1]), "fr", None), (3003, " ".join(words[1]), "fr", "src2")]
    again = ITEM.replace("12", "35").replace("9", "4")
    rows += [(4000, f"{line('en')} {ITEM} {line('en')}", "en", "src1"), (4001, f"{line('en')} {again} {line('en')}", "en", "src2"), (4002, f"{line('en')} {' '.join(ITEM.split()[:9])} {line('en')}", "en", "src2")]
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, now = [docs], spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(p.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/stage{number}")
        now = spark.read.parquet(f"{folder}/stage{number}")
        out.append(now)
    return [{r.doc_id: r for r in d.collect()} if k < 5 else d.collect() for k, d in enumerate(out)]


def test_language(planted):
    assert set(planted[1]) == set(planted[0]) - {1000, 1001, 1002}


def test_lines(planted):
    before, after = planted[1], planted[2]
    first = {}
    for i in sorted(before):
        lines = [x for x in before[i].text.split("\n") if SPACE.search(x)]
        for k in range(len(lines) - 2):
            first.setdefault(tuple(lines[k : k + 3]), (i, k))
    for i in before:
        lines = before[i].text.split("\n")
        gone = {k + j for k in range(len(lines) - 2) for j in range(3) if first[tuple(lines[k : k + 3])] != (i, k)}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if SPACE.search(kept):
            assert after[i].text == kept and after[i].n_chars == len(kept)
        else:
            assert i not in after
    assert after[2000].text == before[2000].text and len(after[2001].text.split("\n")) == 2 and 2002 not in after


def test_near_copies(planted):
    before, after = planted[2], planted[3]
    sets = {i: shingles(r.text) for i, r in before.items()}
    parent = {i: i for i in before}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in before:
        for b in before:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(after) == {i for i in before if root(i) == i}
    assert 3000 in after and 3001 not in after and 3002 in after and 3003 not in after


def test_leaks(planted):
    assert set(planted[4]) == set(planted[3]) - {4000, 4001}


def test_mix(planted):
    before, after = planted[4], planted[5]
    size = {i: len(SPACE.findall(r.text)) for i, r in before.items()}
    sources = sorted({r.source for r in before.values()}, key=lambda s: (s is None, s or ""))
    have = {s: sum(size[i] for i, r in before.items() if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, left = {}, 1.5 * sum(have.values())
    free = set(sources)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * have[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * have[s]
            left -= 2 * have[s]
        free -= over
    for s in sources:
        mine = [r for r in after if r.source == s]
        assert abs(sum(size[r.doc_id] for r in mine) - target[s]) <= max(size[i] for i, r in before.items() if r.source == s)
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == before[r.doc_id].text
    assert max(copies.values()) <= 2
