"""The pipeline as a whole against a version in plain Python, stage after stage, each written out apart from the library."""

import re
import struct
from collections import Counter, defaultdict

from test_llm import brute_classes

import corpus_pipeline
from tenfold.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def bucket(v):
    if v < 256:
        return v
    shift = v.bit_length() - 8
    return shift * 128 + (v >> shift)


def measured(text):
    words = SPACE.findall(text or "")
    joined = "".join(words)
    out = {}
    if words:
        out["word_length"] = bucket(10**6 * len(joined) // len(words))
        out["marks"] = bucket(10**6 * (len(PUNCTUATION.findall(joined)) + 1) // len(joined))
        out["capitals"] = bucket(10**6 * (len(re.findall("[A-Z]", joined)) + 1) // len(joined))
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    repeated = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    return out, len(words) < 10 or 100 * len(repeated) > 20 * len(words)


def quality(rows):
    found = {r.doc_id: measured(r.text) for r in rows}

    def quartiles(values):
        values = sorted(values)
        return [next(v for k, v in enumerate(values, 1) if 100 * k >= q * len(values)) for q in (25, 50, 75)] if values else None

    def limits(r, measure):
        for level, least in ((lambda x: (x.lang, x.source) == (r.lang, r.source), 100), (lambda x: x.lang == r.lang, 100), (lambda x: True, 0)):
            values = [found[x.doc_id][0][measure] for x in rows if level(x) and measure in found[x.doc_id][0]]
            q = quartiles(values)
            if q and len(values) >= least and 0 < q[0] < q[1] < q[2]:
                reach = 12 * min(q[2] - q[1], q[1] - q[0])
                return q[1] - reach, q[1] + reach
        return None

    kept = []
    for r in rows:
        values, failed = found[r.doc_id]
        for measure, v in values.items():
            if (x := limits(r, measure)) and (v > x[1] or measure == "word_length" and v < x[0]):
                failed = True
        if not failed:
            kept.append(r)
    return kept


def without_boilerplate(rows):
    pages, stands = Counter(r.source for r in rows), Counter()
    for r in rows:
        stands.update({(r.source, line) for line in (r.text or "").split("\n") if SPACE.search(line)})
    texts = []
    for r in rows:
        lines = (r.text or "").split("\n")
        good = [line for line in lines if not SPACE.search(line) or stands[r.source, line] < 5 or stands[r.source, line] <= 0.05 * pages[r.source]]
        whole = not any(SPACE.search(line) for line in good)
        texts.append((r.doc_id, r.text if whole or r.text is None else "\n".join(good)))
    return texts


def contaminated(texts, items):
    windows = defaultdict(set)
    for text in items:
        words = ALNUM.findall(lower(text))
        for i in range(max(1, len(words) - 12)) if words else ():
            windows[len(words[i : i + 13])].add(tuple(words[i : i + 13]))
    out = set()
    for doc_id, text in texts:
        words, hit = ALNUM.findall(lower(text)), set()
        for size, wanted in windows.items():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in wanted:
                    hit |= set(range(i, i + size))
        if hit and 20 * len(hit) >= len(words):
            out.add(doc_id)
    return out


def test_whole_pipeline(spark):
    from tokenizers import Tokenizer

    rows = queries.table(spark, SF, "documents").collect()
    good = quality(rows)
    texts = without_boilerplate(good)
    kept = {i for i, _, c in brute_classes(texts, 5, (80, 100)) if i == c}
    texts = [(i, t) for i, t in texts if i in kept]
    bad = contaminated(texts, [r.text for r in queries.table(spark, SF, "benchmark").collect()])
    want = {i: t for i, t in texts if i not in bad}
    assert len(rows) > len(good) > len(kept) > len(want) > 0 and bad  # each stage decides something

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == set(want)
    for doc_id, text in want.items():
        ids = [*(t.encode(text, add_special_tokens=False).ids if text else []), 0]
        mine = sorted(pieces[doc_id], key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == struct.pack(f"<{len(ids)}I", *ids) and {p.doc_tokens for p in mine} == {len(ids)}
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024
