"""Pieces of a byte-level BPE tokenizer that tasks share: words of a text, ids of a word."""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: the byte-level split pattern (fixed value of this tokenizer family)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WORD_END = regex.compile(r"\S(?=\s)")
#: characters of texts that are split at a time
CHARS = 2_000_000
#: what the split pattern tells apart
OTHER, LETTER, NUMBER, SPACE, END = range(5)


def byte_characters() -> list[str]:
    """How byte-level vocabularies write each byte.

    Printable Latin-1 characters stand for themselves, the other bytes for
    U+0100 and following, in order.
    """
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@functools.cache
def character_kinds() -> np.ndarray:
    """The kind of every code point, as the split pattern sees it."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            kinds[points[found.start() : found.end()]] = kind
    return kinds


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about ``CHARS`` characters, cut where white space follows a word: there a word ends anyway."""
    at = 0
    while len(text) - at > CHARS:
        found = WORD_END.search(text, at + CHARS - 1)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def split_all(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as ``SPLIT`` finds them, and where each text's end mark lies among them.

    Every text is followed by a line feed as its end mark, a word of its own.
    Words start where the kind of character changes, but for two rules: the
    last space before a word goes to that word, if it is U+0020, and is a word
    otherwise; and a quote that starts a word takes in the letters of a contraction.
    """
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = character_kinds()[points]
    kinds[ends] = END
    start = np.ones(len(points), dtype=bool)
    start[1:] = kinds[1:] != kinds[:-1]
    start[ends] = True
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] < SPACE))
    start[last] = True
    start[last[points[last] == ord(" ")] + 1] = False
    quotes = np.flatnonzero((points == ord("'")) & start)
    quotes = quotes[kinds[quotes + 1] == LETTER]
    one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
    short = np.isin(one, [*map(ord, "stmd")])
    long = np.isin(one, [*map(ord, "rv")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[quotes[short | long] + 1] = False
    start[quotes[short] + 2] = True
    start[quotes[long] + 3] = True
    at, data = np.flatnonzero(start), joined.encode()
    marks = np.searchsorted(at, ends)
    if len(data) > len(points):
        at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80)[at]
    offsets = np.append(at, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), marks


class Words:
    """A tokenizer file taken apart: texts are split into words, words encoded alone.

    Byte-level BPE never merges across the words of its split pattern, so the
    ids of a text are those of its words in order.  Special tokens of the file
    are words of their own.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without prefix space or normalizer is expected")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = special
        self.find = regex.compile(SPLIT).findall
        self.shown = dict(enumerate(byte_characters()))
        self.ids_of_marks = {m: [self.tokenizer.token_to_id(m)] for m in special}
        self.model = self.tokenizer.model

    def split(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.marks):
            return self.find(text)
        parts = self.special.split(text)  # odd places are the special tokens
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.find(part))]

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the library's model on the word's bytes, written as the vocabulary writes them."""
        if word in self.ids_of_marks:
            return self.ids_of_marks[word]
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]


@functools.cache
def words_of(path: str) -> Words:
    """One instance per worker process and file; the file's path must be readable by every task."""
    return Words(path)


class Encoder(dict):
    """Whole texts to ids; each distinct word of the recent texts is encoded once.

    Maps words to their packed ids.  At most about ``limit`` words are
    remembered, after which the memory starts afresh.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        super().__init__()
        self.words, self.limit = words_of(path), limit
        self.width = np.dtype("<u2") if self.words.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"

    def __missing__(self, word: str) -> bytes:
        ids = self.words.encode(word)
        packed = self[word] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed unsigned integers of ``width``."""
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, self.words.split(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """:meth:`encode` of every text; a word is looked up once in about ``CHARS`` characters."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if any(m in text for m in self.words.marks):  # special tokens are words of their own
                out[i].append(self.encode(text))
                continue
            for part in stretches(text):
                held.append((i, part))
                size += len(part)
                if size >= CHARS:
                    self._encode_held(held, out)
                    held, size = [], 0
        self._encode_held(held, out)
        return [b"".join(parts) for parts in out]

    def _encode_held(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        if not held:
            return
        if len(self) > self.limit:
            self.clear()
        words, marks = split_all([part for _, part in held])
        table = words.dictionary_encode()
        known = [*map(self.__getitem__, table.dictionary.to_numpy(zero_copy_only=False)), b""]
        numbers = table.indices.to_numpy().copy()
        numbers[marks] = len(known) - 1
        ids = pa.array(known, pa.large_binary()).take(pa.array(numbers))
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[np.append(0, marks + 1)].tolist()
        for (i, _), first, until in zip(held, at[:-1], at[1:], strict=True):
            out[i].append(data[first:until].to_pybytes() if until > first else b"")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
