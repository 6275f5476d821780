"""Operators on documents against plain statements of their results, with odd rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import blocks as B
from corpusloom.llm import jaccard_join, suffix_dedup
from corpusloom.llm.blocks import pack
from corpusloom.llm.decontaminate import Decontaminate
from corpusloom.llm.jaccard_join import JaccardJoin
from corpusloom.llm.substring_dedup import FILE_BUCKETS, FingerprintIndex, SubstringDedup
from corpusloom.llm.suffix_dedup import SuffixDedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, alphabet=400):
    return " ".join(f"w{rng.randrange(alphabet)}" for _ in range(n))


def odd_documents():
    """Copies, near copies, shared passages, nulls, empties, repeated rows and ids, a long text."""
    rng = random.Random(5)
    shared, base = prose(rng, 90), prose(rng, 120)
    docs = [(i, prose(rng, rng.randrange(1, 150))) for i in range(40)]
    docs += [(100 + i, f"{prose(rng, 30)}\n{shared}\t{prose(rng, 25)}") for i in range(8)]
    docs += [(200 + i, base) for i in range(6)]
    for i in range(25):
        words = base.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        docs.append((300 + i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, " \n\t "), (403, "a"), (404, "a b c d"), (405, "A b C d"), (406, "x " * 3000), (407, "é日 " * 300), (408, "é日 " * 300)]
    docs += [(500, docs[0][1]), (500, prose(rng, 40)), (500, prose(rng, 40)), (None, base), (None, prose(rng, 60)), (501, prose(rng, 30000, 10**6))]
    return docs


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in docs], SCHEMA).repartition(parts, F.xxhash64("text", "doc_id"))


def ordered(docs):
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    docs = odd_documents()
    return docs, frame(spark, docs).cache()


def unique_ids(docs):
    """Rows whose place among those of one id doesn't matter."""
    return [d for d in docs if d[0] not in (500, None)] + [(500, docs[0][1]), (None, "null id " + "q r s " * 10)]


def test_substring_dedup(spark):
    docs = unique_ids(odd_documents())
    got = rows(SubstringDedup().dedup(frame(spark, docs)))
    assert got == sorted(brute.substring_dedup(ordered(docs)), key=repr)


def test_substring_dedup_gives_rows_for_repeated_ids(odd):
    docs, df = odd
    assert SubstringDedup().dedup(df).count() == len(docs)


@pytest.mark.parametrize("bucket_hashes", [10**6, 2000])
def test_index_across_sessions_equals_one_batch(spark, tmp_path, bucket_hashes):
    """Each batch opens the index anew, with another number of shuffle partitions; small buckets make it grow."""
    docs = sorted(d for d in unique_ids(odd_documents()) if d[0] is not None)
    got = []
    for partitions, part in zip((4, 16, 3, 8), [docs[:30], docs[30:50], docs[50:80], docs[80:]], strict=True):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        index = FingerprintIndex(spark, str(tmp_path / "index"), fanout=2, bucket_hashes=bucket_hashes)
        got += rows(index.add(frame(spark, part)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got, key=repr) == sorted(brute.substring_dedup(docs), key=repr)
    # It began with 4 files; a file never holds more than a few buckets.
    assert index.state["files"] == max(4, 2 ** index.state["bits"] // FILE_BUCKETS) and all(r["files"] == index.state["files"] for r in index.state["runs"])
    assert bucket_hashes > 2000 or index.state["files"] > 4
    assert len(index.state["runs"]) < 4 and max(r["level"] for r in index.state["runs"]) >= 2
    assert sum(r["n"] for r in index.state["runs"]) == len({tuple(w[i : i + 20]) for _, t in docs for w in [brute.SPACE_WORDS.findall(t or "")] for i in range(len(w) - 19)})
    assert rows(index.add(frame(spark, [(9000, docs[0][1] + " tail"), (9001, "fresh words " * 3)]))) == sorted(brute.substring_dedup([*docs, (9000, docs[0][1] + " tail"), (9001, "fresh words " * 3)])[-2:], key=repr)
    # Merging and compacting shuffle no run.
    assert "Exchange" not in index._combined(index._past(index.state["runs"]))._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert not (tmp_path / "index").exists()


def test_a_batch_that_fails_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    docs = sorted(d for d in unique_ids(odd_documents()) if d[0] is not None)[:60]
    index = FingerprintIndex(spark, str(tmp_path / "index"))
    index.add(frame(spark, docs[:30]))
    monkeypatch.setattr(FingerprintIndex, "_publish", lambda self, runs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(frame(spark, docs[30:]))
    monkeypatch.undo()
    again = FingerprintIndex(spark, str(tmp_path / "index"))
    assert rows(again.add(frame(spark, docs[30:]))) == sorted(brute.substring_dedup(docs)[30:], key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60).map(" ".join), min_size=1, max_size=8))
def test_substring_dedup_of_periodic_texts(spark, texts):
    docs = list(enumerate(texts))
    assert rows(SubstringDedup(window=6).dedup(frame(spark, docs))) == sorted(brute.substring_dedup(docs, 6), key=repr)


def test_suffix_dedup(odd):
    docs, df = odd
    assert rows(SuffixDedup().dedup(df)) == sorted(brute.suffix_dedup(docs), key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé", max_size=90), min_size=1, max_size=8))
def test_suffix_dedup_of_periodic_texts(spark, texts):
    docs = list(enumerate(texts))
    assert rows(SuffixDedup(length=12, gram=7).dedup(frame(spark, docs))) == sorted(brute.suffix_dedup(docs, 12), key=repr)


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    """Anchors above the bound for hot ones give the same result."""
    from corpusloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 2)
    docs = odd_documents()
    assert rows(SuffixDedup().dedup(frame(spark, docs, 12))) == sorted(brute.suffix_dedup(docs), key=repr)


def test_suffix_dedup_keeps_other_columns(spark):
    text = "long passage " * 60
    df = spark.createDataFrame([(1, text + "tail", "en", "s", 5), (2, text, None, "t", 6), (3, None, "de", None, 7)], SCHEMA)
    got = {r["doc_id"]: r for r in SuffixDedup().dedup(df, with_text=True, carry=["lang", "source", "n_chars"]).collect()}
    assert (got[1]["lang"], got[2]["source"], got[3]["lang"], got[3]["kept_text"], got[1]["n_chars"]) == ("en", "t", "de", None, 5)
    assert len(got[1]["kept_text"].encode()) == got[1]["n_bytes"] - got[1]["n_removed"]


ITEMS = [(1, "w1 w2 w3"), (2, None), (3, "..."), (4, "X"), (None, "q r s"), (5, "null id"), (6, "null id")]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination(spark, odd, bound):
    docs, df = odd
    items = [*ITEMS, (7, docs[3][1].upper()), (8, odd_documents()[42][1]), (9, docs[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(Decontaminate(broadcast_bytes=bound).annotate_hits(df, bench))
    assert got == sorted(brute.decontaminate(docs, items), key=repr)
    none = Decontaminate(broadcast_bytes=bound).annotate_hits(df, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def test_jaccard_join(odd):
    docs, df = odd
    assert rows(JaccardJoin().components(df)) == sorted(brute.jaccard_join(docs), key=repr)


def test_jaccard_join_of_groups_over_many_tiles(odd):
    """Tiles of four: members of tiles meet, and what stays apart is compared across tiles."""
    docs, df = odd
    wanted = sorted(brute.jaccard_join(docs), key=repr)
    assert rows(JaccardJoin(tile=4).components(df)) == wanted
    assert rows(JaccardJoin(tile=4, hot=3).components(df)) == wanted


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=14).map(" ".join), min_size=2, max_size=25))
def test_jaccard_join_of_small_sets(spark, texts):
    docs = list(enumerate(texts))
    assert rows(JaccardJoin(tile=3, hot=4).components(frame(spark, docs))) == sorted(brute.jaccard_join(docs), key=repr)


@pytest.mark.parametrize("n", [40, 160])
def test_a_chain_of_sets_that_share_but_do_not_link_is_no_group(spark, n):
    """Each text is half its neighbour's: all share prefixes along the chain, none links; pairs that are compared grow with n."""
    rng = random.Random(3)
    halves = [prose(rng, 30, 10**6) for _ in range(n + 1)]
    docs = [(i, f"{halves[i]} {halves[i + 1]}") for i in range(n)]
    df = frame(spark, docs)
    op = JaccardJoin(percent=40)
    sets = jaccard_join.sets_of(pack(df), B.draw_bases(), 5, 40).where("tokens is not null").withColumn("node", F.col("doc_id"))
    sizes = [r["count"] for r in op._groups(op._postings(sets)).groupBy("group").count().collect()]
    assert sum(k * (k - 1) // 2 for k in sizes) <= 2 * n
    assert rows(op.components(df)) == sorted(brute.jaccard_join(docs, 40), key=repr)


def test_a_common_line_links_nothing(spark):
    rng = random.Random(2)
    line = prose(rng, 12)
    docs = [(i, f"{line} {prose(rng, 40, 10**6)}") for i in range(300)]
    assert all(r[0] == r[2] for r in rows(JaccardJoin(tile=16).components(frame(spark, docs, 6))))


def twins():
    """Two words of 1024 letters that polynomials modulo a power of two can't tell apart, whatever the multiplier."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_that_collide_modulo_powers_of_two(spark):
    one, other = twins()
    same = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{same} {one}"), (2, f"{same} {other}")]
    assert [r[2] for r in rows(SubstringDedup().dedup(frame(spark, docs)))] == [0, 0]
    assert [r[2] for r in rows(JaccardJoin().components(frame(spark, docs[:0] + [(1, one), (2, other)])))] == [1, 2]
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    for bound in (1 << 20, 0):
        assert [r[5] for r in rows(Decontaminate(broadcast_bytes=bound).annotate_hits(frame(spark, [(1, other), (2, one)]), bench))] == [False, True]
    assert [r[2] for r in rows(SuffixDedup().dedup(frame(spark, [(1, one), (2, other)])))] == [r[2] for r in sorted(brute.suffix_dedup([(1, one), (2, other)]))]


def test_hashes_are_those_of_plain_arithmetic():
    import numpy as np

    rng = random.Random(4)
    bases = B.draw_bases()
    texts = [rng.randbytes(rng.randrange(300)).replace(b" ", b"") + b" " + rng.randbytes(50) for _ in range(5)]
    block = B.Block(0, np.arange(5), np.ones(5, bool), np.array([len(t) for t in texts]), b"".join(texts))
    words = B.Words(block, bases)
    plain = [sum((c + 1) * pow(bases.byte, i, B.PRIME) for i, c in enumerate(block.bytes[s:e].tolist())) % B.PRIME for s, e in zip(words.start, words.end)]
    assert words.hashes().tolist() == plain
    n = len(plain)
    a = np.array([rng.randrange(n) for _ in range(40)])
    b = np.array([rng.randrange(i, n + 1) for i in a])
    assert words.rolling.raw(a, b).tolist() == [sum(x * pow(bases.word, k, B.PRIME) for k, x in enumerate(plain[i:j])) % B.PRIME for i, j in zip(a, b)]
    other = [sum((c + 1) * pow(bases.byte2, i, B.PRIME) for i, c in enumerate(block.bytes[s:e].tolist())) % B.PRIME for s, e in zip(words.start, words.end)]
    assert words.apart.raw(a, b).tolist() == [sum(x * pow(bases.word2, k, B.PRIME) for k, x in enumerate(other[i:j])) % B.PRIME for i, j in zip(a, b)]


def test_words_of_one_hash_are_told_apart_by_the_second(spark, tmp_path):
    """Where the first hash takes all words for the same (anagrams, at base 1 for bytes), windows still differ."""
    rng = random.Random(8)
    docs = [(i, " ".join("".join(rng.sample("abcdefgh", 8)) for _ in range(40))) for i in range(12)]
    docs += [(20, docs[3][1]), (21, "hgfedcba " + docs[5][1][:260])]
    index = FingerprintIndex(spark, str(tmp_path / "index"))
    bases = B.draw_bases()._replace(byte=1)
    index.state["bases"], index.bases = list(bases), bases
    assert rows(index.add(frame(spark, docs))) == sorted(brute.substring_dedup(docs), key=repr)
    index.drop()


@pytest.mark.parametrize("run", [lambda d, b: SubstringDedup().dedup(d), lambda d, b: SuffixDedup().dedup(d), lambda d, b: JaccardJoin().components(d), lambda d, b: Decontaminate().annotate_hits(d, b)])
def test_empty_tables(spark, run):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert run(docs, bench).collect() == []


@pytest.mark.parametrize("run", [lambda d, b: SubstringDedup().dedup(d), lambda d, b: SuffixDedup().dedup(d), lambda d, b: JaccardJoin().components(d), lambda d, b: Decontaminate().annotate_hits(d, b)])
def test_other_columns_may_clash(spark, run):
    names = ["block_id", "payload", "node", "label", "n_words", "n_bytes", "component_id", "hi", "items", "rest", "a", "b"]
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string").select("*", *(F.lit(1).alias(n) for n in names))
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string").withColumn("run", F.lit(1))
    assert run(docs, bench).count() == 2


def test_blocks_round_trip():
    docs = [(3, b"x y", b"{}"), (None, None, b""), (-1, b"", b"r")]
    block = B.decode_block(7, B.encode_block(docs))
    assert block.ids() == [3, None, -1] and block.lengths.tolist() == [3, -1, 0] and block.rest == [b"{}", b"", b"r"]


def test_winnowing_picks_the_leftmost_smallest():
    import numpy as np

    values = np.array([5, 3, 9, 3, 8, 1, 1, 7], np.uint64) << np.uint64(40)
    w = 3
    assert B.sliding_owner(values, w).tolist() == [min(range(i, i + w), key=lambda j: (values[j], j)) for i in range(len(values) - w + 1)]
    assert len(B.sliding_owner(values[:2], 3)) == 0


def test_suffix_dedup_of_a_passage_in_many_blocks(spark):
    """The default bound for hot anchors: a passage in 100 documents, each a block of its own, and two of its parts."""
    rng = random.Random(9)
    passage = prose(rng, 130, 10**6)
    docs = [(i, f"{prose(rng, 20, 10**6)}\n{passage}\n{prose(rng, 20, 10**6)}") for i in range(100)]
    docs += [(200, passage[:450]), (201, "x" + passage[30:500]), (202, passage[:399]), (203, prose(rng, 150, 10**6))]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in docs], SCHEMA).repartitionByRange(104, "doc_id")
    assert pack(df).count() > 2 * suffix_dedup.HOT_RUNS - 30
    got = rows(SuffixDedup().dedup(df))
    assert got == sorted(brute.suffix_dedup(docs), key=repr) and sum(r[2] > 0 for r in got) == 102
