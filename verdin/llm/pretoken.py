"""Splitting texts by the public byte-level BPE pattern, a whole batch at a time in numpy.

``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts a text where
the character class (letter, number, space, other) changes, with three exceptions: a blank joins
the run after it, the last character of a longer run of spaces stands apart when something follows,
and a one-character apostrophe takes a contraction out of the letters after it.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_CLASSES = None


def _class_table() -> np.ndarray:
    """Class of every code point, asked from the regex library's own Unicode tables."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                if a < 0xD800 and b >= 0xE000:   # a run across the gap of the surrogates
                    table[a:0xD800] = kind
                    a = 0xE000
                table[a:b + 1] = kind
        _CLASSES = table
    return _CLASSES


def token_starts(codes: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Flags of the characters that begin a token; ``doc_start`` flags the first of each text."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    cls = _class_table()[codes]
    space = cls == SPACE
    blank = codes == 0x20
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 0, cls[:-1]
    prev[doc_start] = 0
    start = cls != prev
    # after spaces: a blank has joined this run, and begins the token itself
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    start &= ~(~space & (prev == SPACE) & after_blank)
    # the last of a run of spaces, when something of the same text follows
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~doc_start[1:]
    start |= space & follows
    start |= doc_start
    # contractions
    quote = np.flatnonzero((codes == 0x27) & start)
    if len(quote):
        def at(k):
            i = quote + k
            ok = i < n
            j = np.where(ok, i, 0)
            return np.where(ok, codes[j], 0), np.where(ok, doc_start[j], True)
        c1, d1 = at(1)
        c2, d2 = at(2)
        one = ~d1 & np.isin(c1, [ord(c) for c in "stmd"])
        pair = (c1.astype(np.int64) << 21) | c2
        two = ~d1 & ~d2 & np.isin(pair, [(ord(a) << 21) | ord(b) for a, b in ("re", "ve", "ll")])
        for hit, size in ((one, 2), (two, 3)):
            q = quote[hit]
            start[q + 1] = False
            end = q + size
            end = end[end < n]
            start[end] = start[end] | (cls[end] == LETTER)
    return start


def split_texts(texts: list) -> tuple[pa.Array, np.ndarray]:
    """(all tokens of the batch as an Arrow array, number of tokens of each text).
    Null counts as the empty text, which has no token."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(sizes) - sizes
    doc_start = np.zeros(len(codes), bool)
    doc_start[first[sizes > 0]] = True
    start = token_starts(codes, doc_start)
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    at = np.flatnonzero(start)
    ends = np.cumsum(width)
    offsets = np.empty(len(at) + 1, np.int64)
    offsets[:-1] = (ends - width)[at]
    offsets[-1] = ends[-1] if len(codes) else 0
    data = "".join(texts).encode()
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    seen = np.concatenate([[0], np.cumsum(start)])
    return tokens, seen[first + sizes] - seen[first]


def blocks_of(texts: list, most_chars: int = 2_000_000):
    """(first, last + 1) of runs of texts with about ``most_chars`` characters, one text at least."""
    a, chars = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if i > a and chars + size > most_chars:
            yield a, i
            a, chars = i, 0
        chars += size
    if a < len(texts):
        yield a, len(texts)


class Encoded:
    """Ids of distinct tokens as one flat array with offsets, grown as tokens are met.  Beyond
    ``most`` tokens it begins anew: it only saves encoding a token again."""

    def __init__(self, encode, most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self):
        self.index = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, tokens: pa.Array) -> np.ndarray:
        """Number of each token; unseen ones are encoded first, together."""
        if len(self.index) > self.most:
            self.clear()
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(known < 0)
        if len(at):
            new = [words[i] for i in at]
            known[at] = np.arange(len(self.index), len(self.index) + len(new))
            self.index.update(zip(new, known[at].tolist(), strict=True))
            flat, sizes = self.encode(new)
            first = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, flat])
            self.starts, self.sizes = np.concatenate([self.starts, first]), np.concatenate([self.sizes, sizes])
        return known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these tokens, joined."""
        size = self.sizes[numbers]
        total = int(size.sum())
        shift = np.repeat(self.starts[numbers] - (np.cumsum(size) - size), size)
        return self.flat[np.arange(total) + shift]


def encode_batch(texts: list, table: Encoded) -> list[np.ndarray]:
    """Ids of each text of the batch, through the tokens that the texts share."""
    out = []
    for a, b in blocks_of(texts):
        tokens, counts = split_texts(texts[a:b])
        numbers = table.numbers(tokens)
        flat = table.ids(numbers)
        per_token = np.concatenate([[0], np.cumsum(table.sizes[numbers])])
        ends = per_token[np.cumsum(counts)]
        out += np.split(flat, ends[:-1])
    return out
