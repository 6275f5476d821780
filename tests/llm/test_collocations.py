import random
import re
from collections import Counter

import pytest

from corpusloom.llm import collocations
from corpusloom.llm.collocations import Collocations, scored

DOCS = "doc_id long, text string, lang string"


def by_hand(docs, least=10, most=3, within=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(len(x) > len(g) and 100 * b >= within * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(n, seed):
    draw = random.Random(seed)
    words = ["the", "The", "new", "york", "times", "é", "Ünder", "a\x00b", "don't", "x" * 50, "a\xa0b", "\x1f", "\x85"]
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for _ in range(draw.randint(0, 30)))
        yield i, text + draw.choice(["", "new york times", "The New York Times", "a b c d a b c d"]), draw.choice(["en", "en", "fr", "und", None, ""])


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("most", "within", "bits"), [(2, 50, None), (3, 50, 0), (3, 90, 5), (5, 60, 2)])
def test_phrases_counted_by_hand(spark, monkeypatch, most, within, bits):
    docs = [*made(400, most), (-1, None, "de"), (-2, "", "de"), (-3, " . ", "it"), (-4, "alone", "it")]
    docs += docs[:40]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = rows_of(Collocations(max_words=most, within=within, bits=bits).mine(df))
    assert got == by_hand(docs, most=most, within=within)
    assert len({r[0] for r in got}) > 2 and max(len(r[2].split(" ")) for r in got) == most


def test_only_the_first_are_returned(spark):
    docs = list(made(300, 9))
    assert rows_of(Collocations(top=3).mine(spark.createDataFrame(docs, DOCS))) == by_hand(docs, top=3)


def test_blocks_of_several_sizes_and_many_languages(spark, monkeypatch):
    docs = [(i, "north pole north pole. north pole", f"l{i % 40}") for i in range(400)]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    whole = rows_of(Collocations().mine(df))
    assert whole == by_hand(docs)
    texts = [t.encode() for _, t, _ in docs]
    n, words, codes = collocations._word_block(texts)
    assert n == 6 * len(docs) and words == sorted(words, key=lambda w: (collocations.zlib.crc32(w), w)) and (codes >= 0).sum() == n


def test_a_very_long_text(spark):
    docs = [(1, "one two three four five. " * 200_000, "en"), (2, "one two", "en")]
    assert rows_of(Collocations().mine(spark.createDataFrame(docs, DOCS))) == by_hand(docs)


def test_scores_beyond_64_bits(spark):
    big = 2_000_000_000_000_001
    cases = [(big, [big, big + 1], [big + 7, big]), (big - 1, [big, big], [big, big]), (3, [3, 3], [3, 3]), (7, [9, 11], [13, 10])]
    rows = spark.createDataFrame([("en", str(i), *c) for i, c in enumerate(cases)], "lang string, phrase string, f long, heads array<long>, tails array<long>")
    for r in scored(rows).collect():
        a, heads, tails = cases[int(r["phrase"])]
        want = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(zip(heads, tails)))
        assert (r["score"], r["l"], r["r"]) == (want[0], want[2], want[3])


def test_no_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(i, "x y", "en", "z", 1) for i in range(12)], DOCS + ", phrase string, id int")
    assert rows_of(Collocations().mine(docs)) == [("en", 1, "x y", 12, 12, 12, 24, 1_000_000)]
    assert rows_of(Collocations().mine(docs.limit(0))) == []
    assert rows_of(Collocations().mine(docs.limit(3))) == []
    with pytest.raises(ValueError):
        Collocations(max_words=1)
