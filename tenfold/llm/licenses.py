"""License scan: an exact set-similarity join of text blocks with license templates.

Tokens are put in one order for the whole corpus, rarest first.  A block can hold the
threshold's share of a template only if it has one of the template's first tokens (prefix
filter), enough of the templates' tokens at all (length filter), and enough of them left
after the first shared one (positional filter); what remains is counted out.  Words that
tell licenses apart must be there, and of two templates in one block the one that covers all
that the other covers, and more, is taken.

Blocks are the lines and, for notices wrapped over lines, windows at every token of the
text, as long as the template with room for as many other tokens as the threshold lets
be absent.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base rule with their labels, and notices that templates are made of.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
]
THRESHOLD = 0.8
#: Words that tell licenses apart: a template that has one is not contained without it; "by" is one after "cc" only.
TELLING = frozenset("apache mit gnu mozilla eclipse commons cc by attribution nc noncommercial sa sharealike nd noderivatives".split())
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, n_words long, places array<struct<word: long, label: string>>, blocks array<struct<block: int, label: string, containment: double>>"


def words(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []


def telling(found: list[bytes]) -> set[bytes]:
    """The words of a template that a block must have."""
    own = {w for w in found if w.decode("utf-8", "replace") in TELLING}
    return own if (b"cc", b"by") in zip(found, found[1:], strict=False) else own - {b"by"}


def token_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How often each token of the templates stands in docs; as many rows to the driver as the templates have tokens."""
    tokens = frozenset(w for _, t in templates for w in words(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(filter(tokens.__contains__, words(text.as_py())))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict.fromkeys(tokens, 0) | {bytes(r.token): r.n for r in counted.collect()}


class Join:
    """Finds the templates that a block contains, given the tokens' order. Templates are a parameter of the caller and go to all tasks with it."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        self.rank = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.labels, self.ranks, self.least, self.spans, self.needed, self.index = [], [], [], [], [], {}
        for label, text in templates:
            ranks = sorted({self.rank[w] for w in words(text)})
            if not ranks:
                continue
            least = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            for place, r in enumerate(ranks[: len(ranks) - least + 1]):
                self.index.setdefault(r, []).append((len(self.labels), place))
            self.labels.append(label)
            self.ranks.append(ranks)
            self.least.append(least)
            self.needed.append({self.rank[w] for w in telling(words(text))})
            self.spans.append(max(len(words(text)), math.ceil(len(words(text)) / threshold - 1e-9)))
        order = sorted(self.rank, key=self.rank.get)
        self.firsts = frozenset(order[r] for r in self.index)

    def __call__(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        for k, shared in self.contained(block):
            yield self.labels[k], len(shared) / len(self.ranks[k])

    def candidates(self, block: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """The templates, by number, of which the block has the threshold's share of tokens and the telling ones, and the tokens shared."""
        own = sorted({self.rank[w] for w in block if w in self.rank})
        seen: set[int] = set()
        for at, r in enumerate(own):
            for k, place in self.index.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                least, ranks = self.least[k], self.ranks[k]
                if len(own) < least or min(len(own) - at, len(ranks) - place) < least:
                    continue
                shared = set(own).intersection(ranks)
                if len(shared) >= least and shared >= self.needed[k]:
                    yield k, shared

    def contained(self, block: list[bytes]) -> list[tuple[int, set[int]]]:
        """The candidates, less those that share only a part of what another shares."""
        found = list(self.candidates(block))
        return [(k, shared) for k, shared in found if not any(shared < other for _, other in found)]

    def windows(self, k: int, tokens: list[bytes], free: list[bool]) -> Iterator[tuple[int, int, set[int]]]:
        """(first token, last token, tokens shared) of the best of each run of overlapping windows that hold template k, over tokens that are free."""
        wanted, span, least = set(self.ranks[k]), self.spans[k], self.least[k]
        held: Counter = Counter()
        inside: deque[tuple[int, int]] = deque()
        best, upto = None, -1
        for at, w in enumerate(tokens):
            if not free[at]:
                held.clear()
                inside.clear()
                continue
            if (r := self.rank.get(w)) not in wanted:
                continue
            inside.append((at, r))
            held[r] += 1
            while inside[0][0] <= at - span:
                _, out = inside.popleft()
                held[out] -= 1
                if not held[out]:
                    del held[out]
            if len(held) < least or not held.keys() >= self.needed[k]:
                continue
            first = inside[0][0]
            if best and first > upto:
                yield best
                best = None
            if not best or len(held) > len(best[2]):
                best = (first, at, set(held))
            upto = at
        if best:
            yield best

    def blocks(self, lines: list[list[bytes]]) -> Iterator[tuple[int, str, float]]:
        """(line, label, share): lines that contain templates, and lines in which a window begins that contains one which none of its lines does."""
        found: dict[int, set[int]] = {}
        for n, line in enumerate(lines):
            for k, shared in self.contained(line):
                found.setdefault(k, set()).add(n)
                yield n, self.labels[k], len(shared) / len(self.ranks[k])
        if len(lines) == 1:
            return
        tokens = [w for line in lines for w in line]
        owner = [n for n, line in enumerate(lines) for _ in line]
        held = []
        for k, _ in self.candidates(tokens):
            whole = found.get(k, ())
            held += [(k, *x) for x in self.windows(k, tokens, [n not in whole for n in owner])]
        held.sort(key=lambda x: x[1:3])
        # what covers more: windows, and the lines that hold a template by themselves
        covering = [(first, last, shared) for _, first, last, shared in held]
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line)
        covering += [(starts[n], starts[n] + len(lines[n]) - 1, shared) for n in sorted(set().union(*found.values())) for _, shared in self.contained(lines[n])]
        for k, first, last, shared in held:
            if not any(first <= b and a <= last and shared < other for a, b, other in covering):
                yield owner[first], self.labels[k], len(shared) / len(self.ranks[k])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, blocks): where phrases stand, and which blocks contain which templates.

    Null and empty texts have no words; a template without words is ignored; equal rows get
    equal results; a null doc_id stays null; other columns are left out; empty tables give
    no rows.  A line of any length is one block; the window of a wrapped notice is
    told by the line it begins in.
    """
    templates = TEMPLATES if templates is None else templates
    wanted = [(tuple(words(p)), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    join = Join(templates, token_counts(docs, templates), threshold)

    def places(found: list[bytes]) -> list[dict]:
        out = []
        for phrase, label in wanted:
            if set(phrase).issubset(found):
                at = -1
                while True:
                    try:
                        at = found.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if tuple(found[at : at + len(phrase)]) == phrase:
                        out.append({"word": at, "label": label})
        return sorted(out, key=lambda x: (x["word"], x["label"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        block = pa.list_(pa.struct([("block", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
        for batch in batches:
            n, at, blocks = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                found = words(text)
                n.append(len(found))
                at.append(places(found))
                blocks.append([] if join.firsts.isdisjoint(found) else [{"block": line, "label": label, "containment": share} for line, label, share in join.blocks([words(line) for line in text.split("\n")])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, place), pa.array(blocks, block)], ["doc_id", "n_words", "places", "blocks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
