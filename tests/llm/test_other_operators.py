import hashlib
import json
import math
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat_format as C
from corpusloom.llm import token_counts as T
from corpusloom.llm.embedding_dedup import EmbeddingDedup
from corpusloom.llm.language_id import CrossParser, LanguageId, held_out
from corpusloom.llm.license_scan import TEMPLATES, LicenseScan, Scanner, Template, words
from corpusloom.llm.mixing import PoissonMix, source_rates
from tests.llm.brute import components, sha

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
CHAT = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# --- language identification -----------------------------------------------------------------


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = LanguageId().fit(docs.where(~held_out()))
    got = model.predict(docs.withColumn("held", held_out()), keep=["held", "lang"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_id_of_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "xx"), ("123", "nn"), ("zz", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (4, "the dog", "a"), (5, "le chien " * 30000, "a"), (None, "le chat", "a")], "doc_id long, text string, lang_pred string")
    model = LanguageId().fit(train)
    assert sorted(model.samples) == ["en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in model.predict(docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == got[None][0] == "fr"
    assert LanguageId().fit(train.limit(0)).predict(docs).where("lang_pred <> 'und'").count() == 0
    assert model.annotate(docs.limit(0)).collect() == []
    assert LanguageId().fit(train.where("lang = 'en'")).predict(docs).where("doc_id = 4").first()["score"] == 1.0


def phrases_by_hand(known, normal):
    count = i = 0
    while i < len(normal):
        n = 1
        while i + n < len(normal) and normal[i : i + n + 1] in known:
            n += 1
        i += n
        count += 1
    return count


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc ", max_size=40), st.text(alphabet="abcd ", max_size=600))
def test_phrases_are_the_longest_that_occur(sample, text):
    parser, sparse = CrossParser({"x": sample}), CrossParser({"x": sample}, dense_cells=0)
    assert sparse.phrases([text, text[7:]]).tolist() == parser.phrases([text, text[7:]]).tolist()
    known, normal = parser.normal(sample), parser.normal(text)
    # A phrase that begins with an unknown character ends at once: one of its own.
    if all(c in known for c in normal):
        assert parser.phrases([text])[0][0] == max(1, phrases_by_hand(known, normal)) or not normal


@pytest.mark.parametrize("dense_cells", [1 << 24, 0])
@pytest.mark.parametrize("sample", ["ab" * 700, "a" * 900, "abcabcab" * 90])
def test_phrases_go_on_over_many_pieces(sample, dense_cells):
    """Phrases longer than a piece: every cut falls into one."""
    parser = CrossParser({"x": sample}, dense_cells)
    for text in (sample, sample[5:] + "c" + sample, sample[::-1] + " " + sample):
        known, normal = parser.normal(sample), parser.normal(text)
        if all(c in known for c in normal):
            assert parser.phrases([text, text[3:]])[:, 0].tolist() == [phrases_by_hand(known, t) for t in (normal, normal[3:])]
    assert parser.phrases([sample])[0][0] == 1


def test_predictions_are_those_of_the_plain_parse(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = LanguageId(sample_docs=8, sample_chars=200).fit(docs.where(~held_out()))
    parser = CrossParser(model.samples)
    samples = {k: parser.normal(v) for k, v in model.samples.items()}
    rows = [r for r in docs.select("doc_id", "text").collect() if r["text"] and len(r["text"]) < 3000]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in model.predict(docs).collect()}
    assert len(rows) > 50
    for r in rows[:60]:
        if not any(c.isalpha() for c in r["text"]):
            continue
        normal = parser.normal(r["text"])
        cost = sorted((phrases_by_hand(v, normal) * math.log2(max(len(v), 4096)), k) for k, v in samples.items())
        if all(c in v for v in samples.values() for c in normal):
            assert got[r["doc_id"]] == (cost[0][1], pytest.approx(1 - cost[0][0] / cost[1][0]))
        else:
            assert got[r["doc_id"]][0] == cost[0][1]


def test_only_letters_tell_a_language():
    parser = CrossParser({"de": "der hund und die katze", "en": "the dog and the cat"})
    assert [x for x, _ in parser.predict(["²", "½ ①", "٣٤", "_", "the cat²"])] == ["und"] * 4 + ["en"]
    tie = CrossParser({"b": "one sample", "a": "one sample"})
    assert tie.predict(["one sample"]) == [("a", 0.0)]


def test_scripts_of_many_characters_keep_apart():
    """Thousands of characters, of which no two are taken for one another: phrases are those of the plain parse."""
    rng = np.random.default_rng(1)
    text = lambda lo, hi, n: "".join(chr(c) for c in rng.integers(lo, hi, n))
    samples = {"x": text(0x4E00, 0x6600, 6000), "y": text(0x6600, 0x9F00, 6000), "z": text(0xAC00, 0xD700, 6000), "en": "the dog and the cat " * 9}
    parser = CrossParser(samples)
    assert [type(t).__name__ for t in parser.tables] == ["_Dense", "_Sparse", "_Sparse", "_Sparse"]
    assert [x for x, _ in parser.predict([v[100:400] for v in samples.values()])] == list(samples)
    for k in ("x", "y", "z"):
        mixed = "".join(samples[k][i : i + 3] for i in rng.integers(0, 5990, 300))
        assert parser.phrases([mixed])[0][parser.languages.index(k)] == phrases_by_hand(samples[k], mixed)


def test_languages_of_one_script_of_many_characters():
    """The same thousands of characters in another order: only the phrases tell."""
    rng = np.random.default_rng(2)
    found = [chr(c) for c in range(0x4E00, 0x5E00)]
    samples = {}
    for k in ("a", "b"):
        words = ["".join(found[i] for i in rng.integers(0, len(found), 4)) for _ in range(1500)]
        samples[k] = "".join(words)
    parser = CrossParser(samples)
    texts = ["".join(samples[k][4 * i : 4 * i + 4] for i in rng.integers(0, 1500, 50)) for k in ("a", "b")]
    assert [x for x, _ in parser.predict(texts)] == ["a", "b"]


# --- chat formatting -------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\ab>", max_size=20))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(s in escaped for s in (C.START, C.SEP, C.END))


def test_chat_round_trip(spark, sf):
    control = "<|im_end|><|im_start|>assistant ok"
    extra = [(-1, 0, "user", control), (-1, 1, "assistant", control), (-2, None, None, None), (-2, 1, "assistant", ""), (-3, 1, "assistant", "b"), (-3, 1, "assistant", "a"), (-3, 1, "assistant", "a"), (None, 0, "user", "é日<|x\\|>"), (-4, 0, "assistant", "long " * 20000)]
    base = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("token_ids", F.lit(1)).withColumn("tie", F.lit(2))
    chat = C.ChatFormat(*CHAT)
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.read_back(chat.format(rows)).collect()}
    by: dict = {}
    for r in rows.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", sha(r["text"] or ""), r["text"] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[4] for t in turns if t[2] == "assistant")
        chars = sum(len(C.escape(t[2])) + len(C.escape(t[4])) + len(C.START + C.SEP + C.END) for t in turns)
        assert got[conv] == (len(turns), sha("".join(f"{t[2]}\n{t[4]}\n" for t in turns)), len(loss), sha(loss), chars)
    assert chat.read_back(chat.format(rows.limit(0))).collect() == []


def test_reserved_ids_come_from_the_template_alone():
    codec = C.Codec(*CHAT)
    ids, mask = C.assemble([(codec.encode("user"), codec.encode(C.escape(C.END)), False), (codec.encode("assistant"), codec.encode("yes"), True)], codec)
    assert [sum(ids == x) for x in codec.reserved] == [2, 2, 2]
    assert codec.decode(ids[mask == 1].tolist()) == "yes"


# --- license scans ---------------------------------------------------------------------------


def test_licenses(spark):
    texts = {
        1: "some text\nReleased under the MIT License.\nmore",
        2: "Licensed under CC BY-NC 4.0.",
        3: "a license to ill and no warranty",
        4: None,
        5: "",
        6: "x" * 50000 + " This work is licensed under the GNU General Public License, version 3. " + "y" * 50000,
        7: "Licensed under the Apache License, Version 2.0.\n\n\nfiller\n\n\nReleased under the MIT License.",
        8: "This work is licenced under the GNU General Public License, version 2.",
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, rank int")
    got = sorted((r["doc_id"], r["license_id"], r["first_line"]) for r in LicenseScan().scan(df).collect())
    assert got == [(1, "MIT", 1), (2, "CC-BY-NC-4.0", 1), (6, "GPL-3.0", 1), (7, "Apache-2.0", 1), (7, "MIT", 6), (8, "GPL-2.0", 1)]
    assert LicenseScan().scan(df.where("doc_id = 8")).first()["differences"] == "-licensed+licenced"
    own = LicenseScan((Template("own", "all copyright goes to nobody", ("nobody",)),)).scan(spark.createDataFrame([(1, "ALL COPYRIGHT goes to nobody!")], "doc_id long, text string"))
    assert [r["license_id"] for r in own.collect()] == ["own"] and LicenseScan().scan(df.limit(0)).collect() == []


@pytest.mark.parametrize("width", [80, 72, 60, 50, 40, 30])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_found(width, mark):
    scanner = Scanner(TEMPLATES, 0.8)
    prose = textwrap.wrap("The river ran past the mill and the people of the village went to it in the morning. " * 9, width)
    for t in TEMPLATES:
        text = "\n".join(mark + line for line in [*prose, *textwrap.wrap(t.text, width, break_on_hyphens=False), *prose])
        assert t.license_id in {r[2] for r in scanner.scan(text)}, t.text


def wrapped(text, width=60):
    return "\n".join(textwrap.wrap(text, width, break_on_hyphens=False))


def template(name, k=-1):
    return [t.text for t in TEMPLATES if t.license_id == name][k]


@pytest.mark.parametrize("before, after", [("", ""), ("Copyright (c) 2021, Some One\nAll rights reserved.\n\n", "\n\nThe end of it.")])
@pytest.mark.parametrize("name", sorted({t.license_id for t in TEMPLATES}))
def test_a_whole_licence_is_that_licence_alone(name, before, after):
    scanner = Scanner(TEMPLATES, 0.8)
    for t in TEMPLATES:
        if t.license_id == name:
            assert {r[2] for r in scanner.scan(before + wrapped(t.text) + after)} == {name}, t.text


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("This work is licensed under the GNU General Public License, version 2 or, at your option, version 3.", set()),
        ("This work is licensed under the GNU General Public License, version 2, or (at your option) any later version.", {"GPL-2.0-or-later"}),
        ("This work is licensed under the GNU General Public License, version 2 or later.", {"GPL-2.0-or-later"}),
        ("This work is licensed under the GNU General Public License, version 2. Or call 3 friends.", set()),
        ("This work is licensed under the GNU General Public License, version 2. Call 3 friends.", {"GPL-2.0"}),
        ("Licensed under CC BY 4.0. Released under the MIT License.", {"CC-BY-4.0", "MIT"}),
    ],
)
def test_added_words_that_tell_another_licence(text, wanted):
    assert {r[2] for r in Scanner(TEMPLATES, 0.8).scan(text)} == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Licensed under the MIT license or the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
        ("Licensed under the Apache License, Version 2.0 or the MIT license.", {"MIT", "Apache-2.0"}),
        ("Licensed under the Apache License, Version 2.0, or, at your choice, released under the MIT License.", {"MIT", "Apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 2, or licensed under CC BY-SA 4.0.", {"GPL-2.0", "CC-BY-SA-4.0"}),
        ("SPDX-License-Identifier: MIT", {"MIT"}),
        ("// SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
        ("/* SPDX-License-Identifier: GPL-2.0+ */", {"GPL-2.0-or-later"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}),
        ("SPDX-License-Identifier: (BSD-3-Clause AND ISC)", {"BSD-3-Clause", "ISC"}),
        ("This project is not released under the MIT License.", set()),
        ("It isn't licensed under the MIT license.", set()),
        ("Some of it was never, as people say, released under the MIT License.", set()),
        ("This is not ours. Released under the MIT License.", {"MIT"}),
        ("That is not so\n\nReleased under the MIT License.", {"MIT"}),
        ("Released, but not under the MIT License.", set()),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble", {"GPL-3.0"}),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.", {"LGPL-3.0"}),
    ],
)
def test_dual_licences_spdx_lines_denials_and_full_texts(text, wanted):
    for around in ("", "prose of a river and a mill\n" * 40):
        assert {r[2] for r in Scanner(TEMPLATES, 0.8).scan(f"{around}{text}\n{around}")} == wanted


def test_a_name_clause_tells_another_licence():
    mit = wrapped(template("MIT"))
    clause = wrapped(template("X11")[len(template("MIT")) :].replace("the X Consortium", "the Mill Owners"))
    assert {r[2] for r in Scanner(TEMPLATES, 0.8).scan(f"{mit}\n\n{clause}")} == {"X11"}
    assert {r[2] for r in Scanner(TEMPLATES, 0.8).scan(mit)} == {"MIT"}


def test_of_any_two_licences_side_by_side_none_is_lost():
    """Every pair of whole wordings with "or", "and" or a line between; equal names, and wordings that contain one another, give the one."""
    scanner = Scanner(TEMPLATES, 0.8)
    chosen = {}
    for t in TEMPLATES:
        if not t.text.startswith("SPDX") and not t.text.startswith("GNU "):
            chosen.setdefault(t.license_id, t)
    for a in chosen.values():
        for b in chosen.values():
            if a.license_id == b.license_id:
                continue
            for between in ("\n\n", ".\nOr: "):
                got = {r[2] for r in scanner.scan(a.text.rstrip(".") + "." * (between == "\n\n") + between + b.text)}
                assert got == {a.license_id, b.license_id}, (a.text[-60:], between, b.text[:60])


def test_ranks_are_among_all_templates():
    scanner = Scanner(TEMPLATES, 0.8)
    text = "Released under the MIT License."
    order = [k for _, k in scanner.rank(text)]
    assert [r[3] - 1 for r in scanner.scan(text)] == [next(i for i, k in enumerate(order) if TEMPLATES[k].license_id == "MIT" and scanner.confirm(words(text), k, []) and len(scanner.words[k]) == 5)]


def test_licences_in_one_line_of_any_length():
    scanner = Scanner(TEMPLATES, 0.8)
    prose = "the river ran past the mill and the licence of the people was long " * 700
    text = f"{prose} {template('BSD-3-Clause')} {prose} {template('MIT')} {prose} {template('BSD-2-Clause')}"
    assert [r[2] for r in sorted(scanner.scan(text), key=lambda r: r[0])].count("BSD-3-Clause") == 1
    assert {r[2] for r in scanner.scan(text)} == {"BSD-2-Clause", "BSD-3-Clause", "MIT"} and {r[7] for r in scanner.scan(text)} == {""}


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(range(len(TEMPLATES))), st.lists(st.tuples(st.floats(0, 1), st.sampled_from(["drop", "change", "add"])), max_size=4))
def test_ranks_and_differences_by_hand(k, edits):
    """Savings against a compressor without the dictionary; differences as a plain alignment of words gives them."""
    import difflib

    import zstandard

    own = words(TEMPLATES[k].text)
    said = list(own)
    for at, kind in edits:
        i = int(at * (len(said) - 1))
        if said[i] not in TEMPLATES[k].keys:
            said[i : i + 1] = {"drop": [], "change": ["river"], "add": [said[i], "mill"]}[kind]
    scanner = Scanner(TEMPLATES, 0.8)
    block = " ".join(said)
    plain = len(zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False).compress(block.encode()))
    for saved, j in scanner.rank(block):
        d = zstandard.ZstdCompressionDict(TEMPLATES[j].text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert saved == plain - len(zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block.encode())) > 0
    got = scanner.confirm(said, k, [])
    ops = difflib.SequenceMatcher(None, own, said, autojunk=False).get_opcodes()
    kept = [(a, b, c, d) for op, a, b, c, d in ops if op == "equal"]
    matched = sum(b - a for a, b, _, _ in kept)
    if matched < 0.8 * len(own) or not set(TEMPLATES[k].keys) <= {w for a, b, _, _ in kept for w in own[a:b]}:
        assert got is None
    else:
        inner = [f"-{' '.join(own[a:b])}+{' '.join(said[c:d])}" for op, a, b, c, d in ops if op != "equal" and c >= kept[0][2] and d <= kept[-1][3]]
        assert got[:2] == (matched, "; ".join(inner))


def test_license_lines_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.where("text rlike '(?i)licensed under|released under'").select("doc_id").distinct().count()
    found = LicenseScan().scan(docs)
    assert found.select("doc_id").distinct().count() == lines and found.where("differences <> ''").count() == 0


# --- mixing ----------------------------------------------------------------------------------


def mix_by_hand(docs, alpha=0.5, seed="mix-1"):
    n = Counter(s for _, s in docs)
    total = sum(v**alpha for v in n.values())
    out = []
    for doc_id, source in docs:
        rate = n[source] ** alpha / total * len(docs) / n[source]
        u = int(hashlib.md5(f"{seed}|1|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u and k < 200:
            k += 1
            p *= rate / k
            c += p
        out += [(doc_id, source, i + 1) for i in range(k)]
    return out


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_mixing(spark, bound):
    docs = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(None, None), (7, None), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string").withColumn("rate", F.lit("x")).withColumn("mix_copy", F.lit(0))
    got = PoissonMix(broadcast_bytes=bound).mix(df)
    assert sorted(((r["doc_id"], r["source"], r["mix_copy"]) for r in got.collect()), key=repr) == sorted(mix_by_hand(docs), key=repr)
    assert got.columns == ["doc_id", "source", "rate", "mix_copy", "mix_order"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_mixing_meets_its_targets(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("gone", 9.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in PoissonMix().mix(df, weights.where("source <> 'gone'")).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200
    assert PoissonMix().mix(df.limit(0)).collect() == []
    many = PoissonMix(size=900.0).mix(df.limit(40)).groupBy("doc_id").count().agg(F.avg("count")).first()[0]
    assert abs(many - 900) < 30
    assert source_rates(df, weights).count() == 2


# --- token counts ----------------------------------------------------------------------------

ODD_TEXTS = ["", "İstanbul ΣΑΣ", "a\x1cb", "it's <|endoftext|> ok", "naïve café ½²ª é", " x  y ", "日本語", "👍🏽 don't", "ſ ß ẞ", "x" * 3000, "Ǆ ǅ ª", "'S 'RE I'LL rock'n'roll", "\x85\xa0q", "a1b22c", "!!??", "word " * 3000]


def test_token_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD_TEXTS)] + [(-99, None), (None, "the"), (-1, "the")], docs.schema)
    rows = docs.unionByName(odd).withColumn("n_tokens", F.lit(0))
    library = T.load(WORD_BPE)
    got = Counter(map(tuple, T.TokenCounts(WORD_BPE).count(rows).collect()))
    wanted = Counter()
    for r in rows.collect():
        n = T.library_count(library, r["text"] or "")
        wanted[(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)] += 1
    assert got == wanted
    assert T.TokenCounts(WORD_BPE).count(rows.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_the_library_counts(text):
    counting = counter()
    assert counting.counts([text]) == [T.library_count(counting.tokenizer, text)]


_held = []


def counter():
    if not _held:
        _held.append(T.Counting(WORD_BPE, T.prove_whole_tokens(WORD_BPE)))
    return _held[0]


def test_whole_tokens_are_proved():
    whole = counter().whole
    vocabulary = json.loads(counter().tokenizer.to_str())["model"]["vocab"]
    assert "the" in whole and all(T.library_count(counter().tokenizer, w) == 1 for w in sorted(whole)[::500]) and len(whole) < len(vocabulary)


# --- embeddings ------------------------------------------------------------------------------


def test_links_of_a_large_cluster_are_counted_in_full(spark, monkeypatch):
    """Many tiles to a group and many cells to a component: every link counts, and a list's length doesn't matter."""
    from corpusloom.llm import embedding_dedup

    for name, value in (("TILE", 4), ("TILES", 1), ("CELL", 4)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.01 * rng.standard_normal(16)]) for i in range(60)]
    op = EmbeddingDedup(k=1)
    got = op.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r["n_links"], r["component_id"]) == (59, 0) for r in got) and op.last_recall == 1.0


def test_an_audit_that_falls_short_fails(spark, monkeypatch):
    monkeypatch.setattr(EmbeddingDedup, "_compare", lambda self, grouped, r: grouped.sparkSession.createDataFrame([], "u long, v long, sim double, tree boolean"))
    rows = [(100 * i, [1.0, 0.01 * i]) for i in range(3)]
    with pytest.raises(RuntimeError, match="recall"):
        EmbeddingDedup(rounds=1).components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("step", [(100, 0), (100, 1)], ids=["a cluster among the audited", "nothing audited"])
def test_rare_links_are_found_too(spark, monkeypatch, step):
    from corpusloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one, other = unit(rng.standard_normal((300, 64))), unit(rng.standard_normal((300, 64)))
    other = unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    cluster = rng.standard_normal(64) + 0.01 * rng.standard_normal((250, 64))
    x = np.concatenate([one, 0.92 * one + np.sqrt(1 - 0.92**2) * other, cluster])
    df = spark.createDataFrame([(step[0] * i + step[1], v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    op = EmbeddingDedup()
    links = sorted(r["n_links"] for r in op.components(df).collect())
    assert sum(n == 1 for n in links) >= 0.99 * 600 and op.last_recall >= 0.99
    if step[1]:
        # A slice of all rows, drawn by a hash, is audited in place of ids that link with nothing.
        monkeypatch.setattr(embedding_dedup, "AUDIT_BYTES", 100_000)
        assert sorted(r["n_links"] for r in op.components(df).collect()) == links and op.last_recall >= 0.99
        alone = df.where(f"vec_id <= {100 * 299 + 1}")
        assert sum(r["n_links"] for r in op.components(alone).collect()) == 0 and op.last_recall is None


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    near = [base[i % 20] + 0.1 * rng.standard_normal(16) for i in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*base, *near])]
    rows += [(1000 + i, rows[5][1]) for i in range(4)] + [(2000, [2 * x for x in rows[6][1]]), (2001, None), (2002, []), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15), (2006, [None] + [1.0] * 15), (2007, [1.0, 2.0]), (2008, [1.0, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("x", F.lit(2))
    op = EmbeddingDedup()
    got = sorted(map(tuple, op.components(df).collect()))
    good = [v if v and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for _, v in rows]

    def linked(a, b):
        if a is None or b is None or len(a) != len(b):
            return False
        a, b = np.float64(a), np.float64(b)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9

    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(good[i], good[j])]
    degree = Counter(x for e in links for x in e)
    comp = components(len(rows), links)
    least: dict = {}
    for i, (vec_id, _) in enumerate(rows):
        least[comp[i]] = min(least.get(comp[i], vec_id), vec_id)
    wanted = sorted((vec_id, degree[i], least[comp[i]], vec_id == least[comp[i]]) for i, (vec_id, _) in enumerate(rows))
    missing = sum(w[1] for w in wanted) - sum(g[1] for g in got)
    assert op.last_recall >= 0.9 and 0 <= missing <= 0.02 * sum(w[1] for w in wanted)
    assert sum(g == w for g, w in zip(got, wanted)) >= 0.97 * len(wanted)
    assert EmbeddingDedup().components(df.limit(0)).collect() == []
