"""Tokenizing with the tokenizers library: each different piece of a batch of texts is encoded once.

A text is cut only where the tokenizer itself always cuts, so the ids are those of
encoding the whole text: at runs of ASCII white space for a tokenizer that drops white
space; else at single blanks that begin a run of white space or join the next word.
No cut is made in doubt.  Arrow cuts a batch and numbers its different chunks.

Chunks of ASCII and Latin letters are cut once more, by the tokenizer's own rule, into
words, numbers and marks, and each different one goes to the tokenizer's model, unless it
is kept from before.  The rule is used only where the tokenizer is seen to do the same with
a sample.  Other chunks are encoded in one call, joined by blanks, and their ids are told
apart by the bytes they stand for, where ids stand for bytes, and else by the offsets.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

JOINED_BLANK = re.compile(r" (?<=\S )(?=\S)")
#: White space, in RE2's notation, and a blank beside which a text is cut by JOINED_BLANK only.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DOUBTFUL_BLANK = f"[{_SPACE}] ([{_SPACE}]|$)"
#: Chunks that the rules below cut: of ASCII and of Latin letters with a form in either case; white space that they take one by one.
_LETTERS, _BLANKS = "A-Za-zÀ-ÖØ-öø-þ", r"\t-\r\x{20}"
PLAIN, LONG_SPACE = rf"^[\x01-\x7f{_LETTERS}]*$", f"[{_BLANKS}]{{3}}|[{_BLANKS}]{{2}}$"
_SHORT = "'(?:[sdmt]|ll|ve|re)"
JOINED_RULE = f"({_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[^0-9{_LETTERS}{_BLANKS}]+|[{_BLANKS}])"
RULE = f"({_SHORT}|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}{_BLANKS}]+)"
#: Every plain character, alone and beside others.
PLAIN_CHARS = "".join(c for c in map(chr, range(1, 255)) if re.match("[\x01-\x7fÀ-ÖØ-öø-þ]", c))
SAMPLES = ["it's", " we'LL", "don't've", " ('s", "'tis'", "déjà-vu,", " Été.", "a1b22c", " 345", "x.\n\nAy", " \tz", " ", "\n", "...y!?\x1c", " ''", *PLAIN_CHARS, *(f" a{c}b0{c}.{c}é" for c in PLAIN_CHARS)]
#: Entries that each cache of one Python worker holds before it starts anew, and characters of the longest of them.
CACHE_ENTRIES, CACHED_CHARS = 800_000, 64
#: Bytes of the texts that are encoded together, if no text is longer.
BATCH_BYTES = 8 << 20


def ragged(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of values that begin at first and are counts long, one after another."""
    upto = np.cumsum(counts)
    return values[np.repeat(first - upto + counts, counts) + np.arange(upto[-1] if len(upto) else 0)]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.joins = self._encode(" a").ids != self._encode("a").ids
        self.pieces: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        sample = " aÉ  中\n\U0001f642x"
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.bytewise = self.joins and self.widths[self._encode(sample).ids].sum() == len(sample.encode())
        self.lowers = not self.joins and self._encode("AÉ").ids == self._encode("aé").ids
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): shown.pre_tokenize_str(c)[0][0] for c in PLAIN_CHARS}  # as the model sees them
        samples = [text if self.joins else "".join(text.split()) for text in SAMPLES]
        lists, got = self._by_rule(pa.array(samples, pa.string()))
        self.ruled = [b"".join(got[k] for k in some) for some in lists.to_pylist()] == [self._ids(text) for text in samples]

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4").tobytes()

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text without the blanks between them."""
        if not self.joins:
            return pc.ascii_split_whitespace(texts)
        lists = pc.split_pattern(texts, " ")
        doubtful = pc.match_substring_regex(texts, DOUBTFUL_BLANK)
        if pc.any(doubtful).as_py():
            lists = pa.array([JOINED_BLANK.split(text) if bad else own for text, bad, own in zip(texts.to_pylist(), doubtful.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))
        return lists

    def _by_rule(self, chunks: pa.Array) -> tuple[pa.ListArray, list[bytes]]:
        """The numbers of the pieces of plain chunks, and the ids of each piece."""
        if self.lowers:
            chunks = pc.utf8_lower(chunks)
        lists = pc.split_pattern(pc.replace_substring_regex(chunks, JOINED_RULE if self.joins else RULE, "\\1\0"), "\0")
        numbered = lists.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.pieces.get, pieces))
        new = [k for k, ids in enumerate(got) if ids is None]
        if len(self.pieces) + len(new) > CACHE_ENTRIES:
            self.pieces.clear()
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        found, upto = array("i"), [0]
        for k in new:
            found.extend([token.id for token in tokenize(pieces[k].translate(shown))])
            upto.append(4 * len(found))
        data = np.array(found, "<i4").tobytes()
        for k, low, high in zip(new, upto, upto[1:], strict=False):
            got[k] = data[low:high]
        self.pieces.update((pieces[k], got[k]) for k in new if len(pieces[k]) <= CACHED_CHARS)
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), numbered.indices), got

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of different chunks that may follow each other in a text, each with the blank before it if blanks count."""
        text = "".join(chunks) if self.joins else " ".join(chunks)
        lengths = np.fromiter(map(len, chunks if not self.bytewise or text.isascii() else map(str.encode, chunks)), np.int64)
        starts = np.cumsum(lengths) - lengths + (0 if self.joins else np.arange(len(chunks)))
        if self.bytewise:
            data = self._ids(text)
            at = np.searchsorted(np.cumsum(self.widths[np.frombuffer(data, "<i4")]), starts, "right") * 4
        else:
            encoded = self._encode(text)
            data = np.array(encoded.ids, "<i4").tobytes()
            at = np.searchsorted(np.array([start for start, _ in encoded.offsets], np.int64), starts) * 4
        at[0] = 0
        return {c: data[low:high] for c, low, high in zip(chunks, at.tolist(), [*at[1:].tolist(), len(data)], strict=True)}

    def _by_text(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks of any kind."""
        got = list(map(self.others.get, chunks))
        new = [c for c, ids in zip(chunks, got, strict=True) if ids is None]
        follow = [c for c in new if len(c) > self.joins and not c[-1].isspace() and (c[0] == " " and not c[1].isspace() if self.joins else not c[0].isspace())]
        found = self._learn(follow) if follow else {}
        found.update((c, self._ids(c)) for c in new if c not in found)
        if len(self.others) + len(found) > CACHE_ENTRIES:
            self.others.clear()
        self.others.update((c, ids) for c, ids in found.items() if len(c) <= CACHED_CHARS)
        return [found[c] if ids is None else ids for c, ids in zip(chunks, got, strict=True)]

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different chunks, each with the blank before it if blanks count; the number of each place's chunk; how many places each text has."""
        lists = self._cut(texts.fill_null(""))
        numbered, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        places, chunks = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary
        if not self.joins:
            return chunks, places, sizes
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]  # a text's first chunk has no blank before it
        alone, own = np.unique(places[firsts], return_inverse=True)
        chunks = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), chunks, pa.scalar("")), chunks.take(pa.array(alone))])
        places[firsts] = len(numbered.dictionary) + own
        used = np.bincount(places, minlength=len(chunks)) > 0
        return chunks.filter(pa.array(used)), (np.cumsum(used) - 1)[places], sizes

    def many(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) in their order, the id ``end`` after each, and how many each has with it."""
        chunks, places, sizes = self._chunks(texts)
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring_regex(chunks, LONG_SPACE)).to_numpy(zero_copy_only=False) & self.ruled
        lists, pieces = self._by_rule(chunks.filter(pa.array(plain)))
        others = self._by_text(chunks.filter(pa.array(~plain)).to_pylist())
        # units: pieces, other chunks and the end; plain chunks come first, then the others and the end, which are a unit each
        got = [*pieces, *others, end.to_bytes(4, "little")]
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        units = np.concatenate([lists.values.to_numpy().astype(np.int64), np.arange(len(pieces), len(got))])
        n_units = np.concatenate([np.diff(lists.offsets.to_numpy().astype(np.int64)), np.ones(len(others) + 1, np.int64)])
        ids = ragged(np.frombuffer(b"".join(got), "<i4"), (np.cumsum(lengths) - lengths)[units], lengths[units])
        upto = np.concatenate([[0], np.cumsum(lengths[units])])[np.concatenate([[0], np.cumsum(n_units)])]
        order = np.where(plain, np.cumsum(plain), plain.sum() + np.cumsum(~plain)) - 1
        row = np.insert(order[places], np.cumsum(sizes), len(chunks))
        counts = np.diff(upto)[row]
        ends = np.cumsum(counts)[np.cumsum(sizes + 1) - 1] if len(sizes) else sizes
        return ragged(ids, upto[:-1][row], counts), np.diff(ends, prepend=0)

    def batches(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """What ``many`` gives for consecutive texts of bounded size together, after the place of the first of them."""
        upto, low = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy().astype(np.int64)), 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + BATCH_BYTES, "right")))
            yield low, *self.many(texts.slice(low, high - low), end)
            low = high

    def __call__(self, text: str | None, end: int) -> np.ndarray:
        """The ids of the text (null: none), then the id ``end``."""
        return self.many(pa.array([text], pa.string()), end)[0]


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary."""
    return ChunkEncoder(path)
