"""Corpus operators against brute force, round trips and edge rows."""

import hashlib
import math
import random
import struct
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenfold.llm import components, decontaminate, language_id, licenses, line_dedup, minhash, oracle, packing, quality, queries, suffix_dedup, token_files, tokens, warc
from tenfold.llm.common import ship

SF = "/root/testdata/sf0.001"
EXTRA = ", row string, key string, t string, words int, n int, band int, node string, host string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    ship(spark)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(150), text(60)
    near = base.split()
    near[40] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t", "one", "É É", "a b c", text(30_000), f"{text(50)}\n{passage}\n{text(9)}", f"{text(5)} {passage} {text(40)}", "x" * 3000, "line\nline\nline", text(11)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[4], (None, base, None, None), (None, None, None, None)]
    return spark.createDataFrame([(*r, *["z", "z", "z", 1, 1, 1, "z", "z"]) for r in rows], "doc_id long, text string, lang string, source string" + EXTRA)


def empty(df):
    return df.limit(0)


def same(rows, want):
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_suffix_arrays_are_sorted():
    rng = random.Random(0)
    for data in [b"", b"a", b"aaaa", b"banana", b"mississippi", bytes(rng.choice(b"ab") for _ in range(300)), bytes(rng.randrange(256) for _ in range(300))]:
        if data:
            order = suffix_dedup.suffix_array(data, len(data)).tolist()
            assert order == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("most", [2048, 2])
def test_repeats_against_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "RUNS_AT_ONCE", most)
    got = suffix_dedup.remove_repeats(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    want = zip(rows, suffix_dedup.brute_force([r.text for r in rows]), strict=True)
    same([(r.doc_id, len(r.data) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got], [(r.doc_id, *b) for r, b in want])
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_repeats_of_a_hot_passage(spark, monkeypatch):
    """A passage that stands in many contexts, cut again down to single windows."""
    monkeypatch.setattr(suffix_dedup, "RUNS_AT_ONCE", 3)
    rng = random.Random(9)
    letters = lambda n, of="abcdefghij ": "".join(rng.choice(of) for _ in range(n))
    passage = letters(420)
    texts = [letters(rng.randint(0, 120)) + passage[rng.randint(0, 40) : rng.randint(330, 420)] + letters(rng.randint(0, 120), "ab") for _ in range(40)]
    texts += ["ab" * 300, "ab" * 300 + "c", passage + passage, passage[:199], passage[:200]]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (len(r.data) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == dict(enumerate(suffix_dedup.brute_force(texts)))


def test_quality_on_edges(docs):
    got = quality.score(docs)
    assert got.count() == docs.count() and got.where("row.text IS NULL AND (kept OR n_words > 0)").count() == 0
    assert got.where("row.text = 'line\nline\nline'").first().n_dup_lines == 2
    assert quality.filtered(docs).columns == docs.columns and quality.filtered(empty(docs)).count() == 0


def test_quality_filter_stands_junk(spark):
    """A third of a source is junk, in symbols or in short words; a group of one document, and one of two, hold junk."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = lambda: " ".join(word() for _ in range(60))
    symbols = lambda: " ".join(f"#*{word()}|" for _ in range(60))
    short = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    rows = [(g, good(), "en", s) for s, junk in (("symbols", symbols), ("short", short)) for g in [True] * 200]
    rows += [(False, junk(), "en", s) for s, junk in (("symbols", symbols), ("short", short)) for _ in range(100)]
    rows += [(False, symbols(), "en", "one"), (False, symbols(), "de", "one"), (False, symbols(), "en", "two"), (True, good(), "en", "two")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, good boolean, text string, lang string, source string")
    got = Counter((r.source, r.lang, r.good) for r in quality.filtered(d).collect())
    assert {k: n for k, n in got.items() if k[1:] == ("en", False) or k[0] == "one"} == {}
    assert got["symbols", "en", True] == 200 and got["short", "en", True] == 200 and got["two", "en", True] == 1


def test_limits_come_from_each_groups_sketch(spark):
    """Two sources of one language: what is usual in the wide one is beyond the limits of the narrow one, though a third of that is junk; nothing else tells them apart."""
    rng = random.Random(12)
    sized = lambda low, high: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(low, high))) + rng.choice(["", "", "", "."]) for _ in range(60))
    narrow = [sized(5, 6) for _ in range(300)]
    wide = [sized(k := rng.randint(3, 14), k) for _ in range(300)]
    junk = [sized(12, 13) for _ in range(150)]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([(t, "narrow") for t in narrow + junk] + [(t, "wide") for t in wide])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r.source: r for r in quality.thresholds(quality.sketches(d)).collect()}
    assert {r.word_length_from for r in limits.values()} == {"group"} and limits["narrow"].word_length_high < limits["wide"].word_length_high and limits["narrow"].word_length_low > limits["wide"].word_length_low
    kept = {r.row.doc_id for r in quality.score(d).where("kept").collect()}
    assert set(range(300)) <= kept and set(range(450, 750)) <= kept and not kept & set(range(300, 450))


def test_licenses_on_edges(docs, spark):
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty(docs)).count() == 0
    lines = "foo\nReleased under the mit LICENSE.\nuses GNU General Public License, version 3, this work is licensed under"
    got = licenses.scan(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()
    assert [(p.word, p.label) for p in got.places] == [(4, "mit"), (8, "gpl")] and {(b.block, b.label) for b in got.blocks} >= {(1, "mit"), (2, "gpl")}


def test_set_join_finds_all():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = [(f"l{k}", " ".join(rng.sample(vocabulary, rng.randint(3, 12)))) for k in range(12)]
    join = licenses.Join(templates, {w.encode(): rng.randint(0, 5) for w in vocabulary}, 0.8)
    for _ in range(300):
        block = [rng.choice(vocabulary).encode() for _ in range(rng.randint(0, 60))]
        want = Counter(label for label, t in templates if len(set(block) & {w.encode() for w in t.split()}) >= 0.8 * len(t.split()) - 1e-9)
        assert Counter(label for label, _ in join(block)) == want


@pytest.mark.parametrize("width", [70, 75, 80])
def test_licenses_wrapped_over_lines(spark, width):
    notices = [t for _, t in licenses.TEMPLATES if t.startswith(("Permission is hereby", "This program is free", "Redistribution and"))]
    texts = ["own words\n\n" + "\n".join(f"{mark}{line}" for line in textwrap.wrap(f"{t} and some more words of the notice that go on for a while", width)) for t in notices for mark in ("", " * ")]
    texts += ["\n".join(textwrap.wrap(" ".join(w + " own words" for w in t.split()), width)) for t in notices]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(b.block, b.label, b.containment) for b in r.blocks] for r in got} == {i: [(2, label, 1.0)] for i, label in enumerate(["mit", "mit", "gpl", "gpl", "bsd", "bsd"])} | {6: [], 7: [], 8: []}


@pytest.mark.parametrize("width", [60, 78])
def test_whole_notices_wrapped_over_lines(spark, width):
    """Every template of several sentences is found as a wrapped paragraph, with a word in ten changed too, and under its own label only."""
    long = [(label, t) for label, t in licenses.TEMPLATES if len(t.split()) > 25]
    changed = lambda t: " ".join("other" if i % 10 == 4 else w for i, w in enumerate(t.split()))
    texts = ["head\n\n" + "\n".join(textwrap.wrap(x, width)) + "\n\ntail" for _, t in long for x in (t, changed(t))]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(long) >= 4 and {r.doc_id: {b.label for b in r.blocks} for r in got} == {i: {long[i // 2][0]} for i in range(len(texts))}


def test_licenses_are_told_apart_by_names_only(spark):
    """A notice that has lost an everyday word is found; a license whose name lacks a part is not guessed."""
    notice = next(t for label, t in licenses.TEMPLATES if label == "apache" and len(t.split()) > 25)
    texts = [notice.replace("required by", "required under"), notice.replace("apache", "other"), "Licensed under CC 4.0", "Licensed under CC BY 4.0"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: {b.label for b in r.blocks} for r in got} == {0: {"apache"}, 1: set(), 2: set(), 3: {"cc-by"}}


def test_license_short_form(spark):
    got = licenses.scan(spark.createDataFrame([(1, "own text\nLicensed under CC BY-NC 4.0.\n"), (2, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")).collect()
    assert {r.doc_id: {b.label for b in r.blocks} for r in got} == {1: {"cc-by-nc"}, 2: {"apache"}}


def test_licenses_that_are_nearly_alike(spark):
    """Each form of an attribution license gets its own label only, in one line and wrapped; a license's name is never guessed."""
    forms = {"cc-by": ("CC BY 4.0", "Attribution 4.0"), "cc-by-sa": ("CC BY-SA 4.0", "Attribution-ShareAlike 4.0"), "cc-by-nd": ("CC BY-ND 4.0", "Attribution-NoDerivatives 4.0"), "cc-by-nc": ("CC BY-NC 4.0", "Attribution-NonCommercial 4.0"), "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0"), "cc-by-nc-nd": ("CC BY-NC-ND 3.0", "Attribution-NonCommercial-NoDerivatives 3.0")}
    texts = [(label, t) for label, (short, long) in forms.items() for t in (f"Licensed under {short}.", f"This work is licensed under a Creative Commons {long} International License.", f"own words\nThis work is licensed under a\nCreative Commons {long}\nInternational License\nmore words", f"Licensed under\n{short} by the authors")]
    texts += [("", "Released under the License"), ("", "Released under the Apache License"), ("", "Licensed under the terms of version 4.0")]
    texts += [("apache,mit", "Released under the MIT License, or licensed under the Apache License, Version 2.0")]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: ",".join(sorted({b.label for b in r.blocks})) for r in got} == {i: label for i, (label, _) in enumerate(texts)}


def test_windows_find_all():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(25)]
    templates = [(f"l{k}", " ".join(rng.choices(vocabulary, k=rng.randint(4, 12)))) for k in range(8)]
    join = licenses.Join(templates, {w.encode(): rng.randint(0, 5) for w in vocabulary}, 0.8)
    seen = 0
    for _ in range(200):
        lines = [[rng.choice([*vocabulary, "x", "y"]).encode() for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 12))]
        tokens = [w for line in lines for w in line]
        want = set()
        for label, t in templates:
            own, span = {w.encode() for w in t.split()}, math.ceil(len(t.split()) / 0.8 - 1e-9)
            if max(len(own.intersection(x)) for x in [*lines, *(tokens[i : i + span] for i in range(len(tokens)))]) >= 0.8 * len(own) - 1e-9:
                want.add(label)
        assert {label for _, label, _ in join.blocks(lines)} == want
        seen += len(want - {label for line in lines for label, _ in join(line)})
    assert seen > 0


def test_fill_is_closest():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        taken = packing.fill(counts, 31)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= 31) and all(n <= counts[k] for k, n in taken.items())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    path, rng = queries.vocabulary(name), random.Random(1)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = tokens.ChunkEncoder(path)
    parts = ["a", "\u00e9", "e\u0301", " ", "  ", "\n", "\t", "'s", "1", "\u00b2", "\u00a0", "\u2003", "\u4e2d", "<unk>", "<|endoftext|>", "\x1c", "\x00", "\u00df", "\ufb01", "\U0001f642", "..", "\r\n", "don't"]
    for text in ["", " ", " a", "a ", "x" * 5000, *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000))]:
        assert encode(text, 7).tolist() == [*t.encode(text, add_special_tokens=False).ids, 7]
    assert encode(None, 7).tolist() == [7]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_give_the_ids_of_whole_texts(name, monkeypatch):
    """Texts encoded together, in batches of any size, with doubtful white space, marks about words, and chunks of no rule."""
    from tokenizers import Tokenizer

    path, rng = queries.vocabulary(name), random.Random(3)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = tokens.ChunkEncoder(path)
    assert encode.ruled
    monkeypatch.setattr(tokens, "BATCH_BYTES", 5000)
    pools = [["ab", "Cd", "\u00e9", " ", " ", "\n", "'s", "12", ".", ",", "\n\n", "don't"], ["\u00a0", " ", "\n", "\u4e2d", "a", "\x1c"], ["\u0130", "\u017f", "\u212a", "\u00ff", "\u0301", "e", "\x00", "\x85", " ", " ", "</w>", "\u00aa"]]
    texts = [None, "", " ", "\n ", "a ", " a", "y" * 70, *("".join(rng.choices(pool, k=rng.randint(1, 40))) for pool in pools for _ in range(700))]
    rng.shuffle(texts)
    got = []
    for low, ids, sizes in encode.batches(pa.array(["cut off", *texts], pa.string()).slice(1), 7):
        assert low == len(got) and sizes.sum() == len(ids)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [[*(t.encode(x, add_special_tokens=False).ids if x else []), 7] for x in texts]
    assert [len(x) for x in encode.many(pa.array([], pa.string()), 7)] == [0, 0] and list(encode.batches(pa.array([], pa.string()), 7)) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_once_whatever_stands_about_them(name, monkeypatch):
    encode = tokens.ChunkEncoder(queries.vocabulary(name))
    monkeypatch.setattr(encode, "_ids", None)  # no text goes through the whole tokenizer
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    before = len(encode.pieces)
    for mark in (",", ".", ";", "!", "\n(", ").", "?\n\nAnd", "-x"):
        encode.many(pa.array(["_ " + " ".join(w + mark + " e" for w in words)]), 0)
    assert len(words) <= len(encode.pieces) - before <= len(words) + 40


def test_packing_keeps_every_id(docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    pieces = packing.pack(docs, path).collect()
    held = Counter()
    for p in pieces:
        held[p.doc_id, p.start, p.ids] += 1
    whole = Counter()
    for r in docs.collect():
        ids = [*(t.encode(r.text, add_special_tokens=False).ids if r.text else []), 0]
        whole[r.doc_id, struct.pack(f"<{len(ids)}I", *ids)] += 1
    assert sum(p.length for p in pieces) == sum(len(ids) // 4 * n for (_, ids), n in whole.items())
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for (doc_id, ids), n in whole.items():
        if doc_id is not None and sum(m for (d, _), m in whole.items() if d == doc_id) == 1:
            assert b"".join(p.ids for p in sorted(by_doc[doc_id], key=lambda p: p.start)) == ids
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    padding = sum(0 if (n := sum(k for _, k in x)) & (n - 1) == 0 else 1024 - n for x in sequences.values())
    assert padding <= 0.05 * sum(p.length for p in pieces)
    assert packing.pack(empty(docs), path).count() == 0


def test_token_files_round_trip(docs, spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for encoding in ("delta", "dictionary"):
        at = token_files.write(docs, path, encoding=encoding)
        got = token_files.with_crc32(token_files.with_starts(token_files.read(spark, at))).collect()
        want = [[*(t.encode(r.text, add_special_tokens=False).ids if r.text else []), 2] for r in docs.collect()]
        assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r.doc_id, zlib.crc32(struct.pack(f"<{len(w)}I", *w))) for r, w in zip(docs.collect(), want, strict=True))
        ordered = sorted(got, key=lambda r: r.start)
        assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
        assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r.doc_id for r in ordered if r.doc_id is not None)
        assert token_files.read(spark, at, ["doc_id"], (1, 3)).count() == docs.where("doc_id BETWEEN 1 AND 3").count()
    assert token_files.read(spark, token_files.write(empty(docs), path)).count() == 0


def test_decontamination(docs, spark):
    passage = docs.where("doc_id = 10").first().text.split("\n")[1]
    items = spark.createDataFrame([(1, passage, "z"), (1, passage, "z"), (2, None, "z"), (3, "", "z"), (4, "a B c", "z"), (None, "é é", "z")], "item_id long, text string, words string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.found, r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert len([r for r in decontaminate.contamination(docs, items).collect()]) == docs.count()
    assert {k[0] for k, v in got.items() if v[0]} == {8, 10, 11} and got[8, 3] == (3, ["4"], True)
    assert all(got[k][0] == 60 and got[k][1] == ["1"] for k in got if k[0] in (10, 11))
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontaminate.contamination(docs, empty(items)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(docs), items).count() == 0
    shuffled = " ".join(sorted(passage.split()[:13]))
    other = spark.createDataFrame([(1, shuffled)], "doc_id long, text string")
    assert {r.exact for r in decontaminate.near_matches(other, items).collect()} == {False}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_near_items_by_brute_force(spark, monkeypatch, broadcast):
    """Few different words, items of any length, null and empty ones, repeated rows: near items by the definition, with and without a broadcast."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "e", "f", "g", "é"]) + rng.choice(["", "1", "2", "3"]) for _ in range(n))
    items = [(i, draw(rng.choice([2, 5, 13, 20, 30]))) for i in range(12)] + [(98, None), (99, "")]
    texts = [(i, draw(rng.choice([0, 1, 12, 40, 80]))) for i in range(60)] + [(70, None), (71, items[3][1] + " and more")]
    for i, (_, text) in enumerate(items[:12]):  # some words of an item in another order, or replaced
        found = text.split()
        rng.shuffle(found)
        texts.append((80 + i, " ".join("x" if rng.random() < 0.15 else w for w in found)))
    texts.append(texts[0])
    counts = Counter(w for _, t in texts for w in (t or "").split())
    want = {}
    for doc, text in texts:
        found, near = (text or "").split(), set()
        for item, said in items:
            of = (said or "").split()
            for w in [of[k : k + 13] for k in range(max(1, len(of) - 12))] if of else []:
                different = sorted(set(w), key=lambda x: (counts[x], x))
                least = math.ceil(0.8 * len(different))
                if any(x in different[: len(different) - least + 1] and len({*found[max(0, p - 12) : p + 13]} & {*w}) >= least for p, x in enumerate(found)):
                    near.add(str(item))
        want[doc] = sorted(near)
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), near=0.8).collect()
    assert len(got) == len(texts) and {r.doc_id: r.near for r in got} == want and sum(map(bool, want.values())) > 10
    assert all(set(r.found) <= set(r.near) for r in got)


def test_near_matches_without_the_rarest_words(spark):
    item = [f"w{i:02}" for i in range(13)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(item))
    texts = [changed(*at) for at in [(), (0,), (0, 1), (0, 1, 2), (5,), (0, 12), (3, 4, 5, 6)]] + ["w05 w06"] * 3
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = [i for i, t in enumerate(texts) if len(set(t.split()) & set(item)) >= 0.8 * 13]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {bytes(r.key): r.doc_id for r in d.select("doc_id", decontaminate.row_key(F.col("doc_id"), F.col("text")).alias("key")).collect()}
    assert sorted({keys[bytes(r.key)] for r in decontaminate.near_matches(d, items).collect()}) == want == [0, 1, 2, 4, 5]
    unseen = spark.createDataFrame([(1, changed(0))], "doc_id long, text string")
    assert decontaminate.near_matches(unseen, items).count() > 0


def test_language_against_a_plain_forward_pass(spark):
    """Embedding, filters, maximum and softmax written out, on whole texts of several windows."""
    import numpy as np

    d = queries.table(spark, "/root/testdata/sf0.01", "documents").limit(120)
    x, y, labels = language_id.sample(d)
    p = language_id.parameters(x, y, labels)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d, language_id.folded(p, labels)).collect()}
    places = language_id.WINDOW - max(language_id.WIDTHS) + 1
    for r in d.collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        logits = []
        for row in language_id.windows(r.text):
            e = p["E"][row]
            pooled = [max(e[i : i + w].reshape(-1) @ p[f"K{w}"][:, f] for i in range(places)) for w in language_id.WIDTHS for f in range(language_id.FILTERS)] if len(logits) < 3 else None
            logits.append(np.maximum(np.array(pooled) + p["b"], 0) @ p["W"] + p["c"] if pooled else None)
        if None not in [None if z is None else 0 for z in logits]:  # long texts would take too long here
            mean = np.mean(logits, 0)
            soft = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
            assert got[r.doc_id][0] == labels[int(soft.argmax())] and abs(got[r.doc_id][1] - soft.max()) < 1e-4


def test_language_needs_letters(spark):
    d = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167 12"), (2, "\u00bd a")], "doc_id long, text string")
    model = language_id.fit(language_id.windows("some words in a text"), __import__("numpy").zeros(1, int), ["en"])
    assert {r.doc_id: r.lang_pred for r in language_id.predict(d, model).collect()} == {1: "und", 2: "en"}


def test_language_held_out(spark):
    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.predict(d, language_id.train(d.where(~queries.held_out()))).join(d.select("doc_id", "lang"), "doc_id").where(queries.held_out())
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_on_edges(docs):
    model = language_id.train(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language_id.train(empty(docs)) is None and {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty(docs), model).count() == 0


def test_warc_round_trip(spark):
    big, small = "é" * 60, "tiny"
    pages = spark.createDataFrame([(3, "u\r\nv", big, 1), (1, "u", big, 1), (2, None, small, 1), (4, "u", small, 1), (5, "u", None, 1), (None, "u", big, 1), (1, "u", big, 1), (6, "u", "\r\n\r\n" * 40, 1)], "page_id long, url string, html string, n int")
    got = warc.read(warc.write(pages)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.error) for r in got) == Counter([(3, "revisit", 1, None), (1, "response", None, None), (1, "response", None, None), (2, "response", None, None), (4, "response", None, None), (5, "response", None, None), (None, "revisit", 1, None), (6, "response", None, None)])
    assert {r.payload_bytes for r in got} == {120, 4, 0, 160} and all(r.payload_digest == hashlib.sha256(r.payload).hexdigest() for r in got if r.record_type == "response")
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_dictionary_and_damage():
    records = [warc.record(i, "u", "response", None, hashlib.sha256(p := (b"<p>common words %d</p>" % i) * 60).hexdigest(), p) for i in range(300)]
    data = warc.archive(records)
    assert struct.unpack_from("<II", data)[1] > 0 and list(warc.frames(data)) == records
    assert warc.parse(records[0])["error"] is None and warc.parse(records[0][:-1])["error"] and warc.parse(records[0].replace(b"common", b"commoN", 1))["error"] and warc.parse(b"x")["error"]
    with pytest.raises(Exception):
        list(warc.frames(data[:-3]))


def test_line_dedup(docs, spark):
    pages = spark.createDataFrame([(i, f"menu\nown {i}\n", "h" if i < 9 else None, 1) for i in range(12)] + [(99, "menu", "h", 1), (98, None, "h", 1)], "doc_id long, text string, source string, bad int")
    got = {r.row.doc_id: (r.text, r.n_removed) for r in line_dedup.clean(pages, least_pages=5, keep_copies=True).collect()}
    assert got[0] == ("own 0\n", 1) and got[10] == ("menu\nown 10\n", 0) and got[99] == ("menu", 0) and got[98] == (None, 0)
    assert line_dedup.cleaned(docs).columns == docs.columns and line_dedup.cleaned(docs).count() == docs.count() and line_dedup.cleaned(empty(docs)).count() == 0


def test_line_dedup_by_its_ratio_alone(spark):
    """Small hosts lose lines that stand on two pages, pages of nothing but boilerplate are emptied, a line on one page stays."""
    rows = [(1, "menu\nown 1", "http://User@A.example:80/x"), (2, "menu\nown 2", "https://a.example/y?z"), (3, "menu", "http://a.example"), (4, "menu\nonly here", "http://b.example/"), (5, "menu", None), (6, None, "http://a.example/")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("host", line_dedup.host_of(F.col("url")))
    got = {r.row.page_id: (r.row.host, r.text, r.n_removed) for r in line_dedup.clean(pages, "host", "html").collect()}
    assert got == {1: ("a.example", "own 1", 1), 2: ("a.example", "own 2", 1), 3: ("a.example", "", 1), 4: ("b.example", "menu\nonly here", 0), 5: (None, "menu", 0), 6: ("a.example", None, 0)}


def test_line_dedup_on_a_large_host(spark):
    stock, rare = range(0, 500, 10), range(0, 500, 50)
    pages = spark.createDataFrame([(i, "\n".join([f"own {i}"] + ["stock"] * (i in stock) + ["rare"] * (i in rare)), "h") for i in range(500)], "doc_id long, text string, source string")
    got = {r.row.doc_id: r.text for r in line_dedup.clean(pages).collect()}
    assert got == {i: f"own {i}" + "\nrare" * (i in rare) for i in range(500)}


def brute_classes(rows, k, share):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def up(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]):
                top[up(i)] = up(j)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[up(i)] = min(doc_id, least[up(i)]) if least[up(i)] is not None else doc_id
    return [(doc_id, len(s), least[up(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("k,share", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_against_brute_force(docs, spark, monkeypatch, k, share):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SPLIT", 7)
    monkeypatch.setattr(minhash, "HUBS", 2)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((1000 + i, " ".join(copy).upper() if i % 2 else " ".join(copy)))
    rows += [(r.doc_id, r.text) for r in docs.collect()]
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, share).collect()
    blank = {3, 4, 5, None}
    want = [w for w in brute_classes(rows, k, share)]
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles or r.doc_id not in blank], [w for w in want if w[1] or w[0] not in blank])
    assert all(r.component_id == r.doc_id for r in got if not r.n_shingles)


def test_long_words_do_not_collide(spark):
    """A polynomial modulo a power of two gives these two words of 1,024 bytes one hash."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 1)}


def test_deduplicated_keeps_one(docs):
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns and minhash.deduplicated(empty(docs)).count() == 0
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(0) == 1 and 1 not in kept and kept.count(3) == 1 and {6, 9, 10, 11, 12} <= set(kept)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_registered_suffix_dedup(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()), *b) for r, b in zip(rows, suffix_dedup.brute_force([r.text for r in rows]), strict=True)]
    got = queries.op1_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same([tuple(r) for r in got.collect()], want)


def test_registered_minhash(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.op9_minhash(spark, SF).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute_classes(rows, 3, (85, 100)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def encoded(spark, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    t.encode_special_tokens = True
    return {r.doc_id: [*(t.encode(r.text, add_special_tokens=False).ids if r.text else []), end] for r in queries.table(spark, SF, "documents").collect()}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_registered_packing(spark):
    ids, sequences, pieces = encoded(spark, "byte_bpe_50k.json", 0), defaultdict(list), defaultdict(list)
    for p in queries.op4_packing(spark, SF).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length]) and p.length > 0
        pieces[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for got, lengths in ((pieces, {k: len(v) for k, v in ids.items()}), (sequences, None)):
        for k, parts in got.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == lengths[k] if lengths else at <= 1024
    assert set(pieces) == set(ids)
    full = [sum(n for _, n in x) for x in sequences.values()]
    assert sum(1024 - n for n in full if n & (n - 1)) < 0.05 * sum(full)


def test_registered_token_files(spark):
    ids, at = encoded(spark, "word_bpe_49k.json", 2), 0
    got = {r.doc_id: r for r in queries.op10_token_files(spark, SF).collect()}
    assert set(got) == set(ids)
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids[k]), crc(ids[k]))
        at += len(ids[k])


def test_registered_language_id(spark):
    rows = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    lang = {r.doc_id: (r.lang, r.text) for r in queries.table(spark, SF, "documents").collect()}
    assert set(rows) == set(lang) and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in rows.items())
    assert all((rows[k].lang_pred == "und") == (not t or not any(map(str.isalpha, t))) for k, (_, t) in lang.items())


def test_selective_token_reads(spark):
    """Column and page indexes are there, few columns are read, and a range of documents is pushed down to the files."""
    import pyarrow.parquet as pq

    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    path = token_files.write(d, queries.vocabulary("word_bpe_49k.json"), page_bytes=4096)
    file = pq.ParquetFile(token_files.read(spark, path).inputFiles()[0].removeprefix("file://"))
    column = [file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)]
    assert all(c.has_column_index and c.has_offset_index for c in column) and "DELTA_BINARY_PACKED" in str(column[-1].encodings)
    some = token_files.read(spark, path, ["doc_id", "n_tokens"], (10, 20))
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "token_ids" not in plan.split("ReadSchema")[-1]
    assert sorted(r.doc_id for r in some.collect()) == list(range(10, 21))


def test_sketches_merge_and_have_no_top(spark):
    """Parts' sketches added up are those of the whole; a language without blanks has thresholds of its own; null groups count."""
    rng = random.Random(5)
    wide = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(380, 420))) for _ in range(n))
    rows = [(i, wide(12), None, "s") for i in range(150)] + [(900, " ".join(f"{i}" + "x" * 4000 for i in range(12)), None, "s"), (901, " ".join("ab" + str(i) for i in range(12)), None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    parts = [quality.sketches(d.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    merged = parts[0].union(parts[1]).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    same(merged.collect(), quality.sketches(d).collect())
    assert {r.row.doc_id for r in quality.score(d).where("NOT kept AND NOT base_failed").collect()} == {900, 901}
    values = [*range(200), *(rng.randrange(10**9) for _ in range(300))]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.lit(1_000_000).alias("n_words"), F.col("v").alias("word_chars")).select("v", quality.bucket("word_length").alias("b")).select("v", F.expr(quality.least_value("b")).alias("low"), "b").collect()
    assert all(r.low <= r.v and (r.v - r.low) * 128 <= r.v for r in got) and [r.b for r in sorted(got, key=lambda r: r.v)] == sorted(r.b for r in got)


def test_a_very_long_page(spark):
    long = "<p>" + "long page " * ((warc.ARCHIVE_BYTES // 10) + 100)
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", long), (3, "u", long), (4, "u", "a" * 200)], "page_id long, url string, html string")
    got = warc.read(warc.write(pages.coalesce(1))).select("page_id", "record_type", "refers_to", "payload_bytes", "error").collect()
    assert sorted(map(tuple, got)) == [(1, "response", None, 200, None), (2, "response", None, len(long), None), (3, "revisit", 2, len(long), None), (4, "revisit", 1, 200, None)]


def test_archives_of_other_writers(spark):
    """No dictionary frame, an empty and a compressed dictionary, skippable frames between records, addresses with blanks."""
    import zstandard

    rng = random.Random(3)
    records = [warc.record(i, f" http://a.example/{i} ", "response", None, hashlib.sha256(p := " ".join(rng.choices(["some", "html", "of", "pages"], k=50)).encode()).hexdigest(), p) for i in range(300)]
    data = warc.archive(records)
    size = struct.unpack_from("<I", data, 4)[0]
    assert list(warc.frames(data)) == records and {warc.parse(r)["url"] for r in records} == {f" http://a.example/{i} " for i in range(300)}
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    assert list(warc.frames(data[:4] + struct.pack("<I", len(packed)) + packed + data[8 + size :])) == records
    plain = [zstandard.ZstdCompressor().compress(r) for r in records]
    skipped = struct.pack("<II", 0x184D2A53, 5) + b"notes"
    assert list(warc.frames(b"".join(plain))) == records == list(warc.frames(data[:4] + struct.pack("<I", 0) + skipped.join(plain)))
    for broken in (b"", data[:5], b"not an archive", b"".join(plain)[:-3]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(broken))


def test_reading_an_archive_takes_time_in_proportion():
    import time

    def seconds(n):
        data = warc.archive([warc.record(i, "u", "response", None, "0", hashlib.sha256(str(i).encode()).digest() * 90) for i in range(n)])
        began = time.perf_counter()
        assert sum(1 for _ in warc.frames(data)) == n
        return time.perf_counter() - began

    assert min(seconds(8000) for _ in range(2)) < 12 * min(seconds(1000) for _ in range(3))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    same(got.select(*cols).collect() and [tuple(r) for r in got.select(*cols).collect()], con.execute(f"SELECT {', '.join(cols)} FROM ({oracle.SQL[name]})").fetchall())


def test_pipeline_stages_on_edges(docs, spark):
    d = docs.withColumn("n_chars", F.length("text").cast("long"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, SF)
        if k < 4:
            assert d.columns == [*docs.columns, "n_chars"]
            d = spark.createDataFrame(d.collect(), d.schema)
    assert d.count() > 0
    none = empty(docs).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_pipeline_against_brute_force(spark):
    """Near-dedup and decontamination of the pipeline's own input, and the ids that packing keeps."""
    d = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:2]:
        d = stage(spark, d, SF)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    kept = {i for i, _, c in brute_classes(rows, 5, (80, 100)) if i == c}
    deduped = corpus_pipeline.near_dedup(spark, d, SF)
    assert {r.doc_id for r in deduped.collect()} == kept
    last = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    bad = {r.doc_id for r in decontaminate.contamination(deduped, queries.table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert last == kept - bad
