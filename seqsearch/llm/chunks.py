"""Split texts where byte-level BPE tokenizers split them anyway, and encode each distinct piece once.

The pre-tokenizer of the byte-level vocabularies never lets a word run from a character that isn't white space into one
that is, and what it makes of the rest of a text does not depend on what stands before. So ``encode(text)`` is the
concatenation of ``encode(piece)`` over pieces that begin where white space follows something else. Pieces are found in
the bytes of an Arrow column at once, and made distinct by Arrow; only distinct ones reach Python.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Byte-level vocabularies spell the bytes that don't print, and the space, as characters from U+0100 on.
BYTE_NAMES = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)], range(256, 512), strict=False))
_SPELLED = {b: BYTE_NAMES.get(b, b) for b in range(256)}
#: Texts are encoded in groups of about so many bytes; a longer one is cut into several at its pieces' ends.
GROUP = 8 << 20

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Bytes before a gap that are, or may be the end of, white space of another kind.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0x1C, 0x1D, 0x1E, 0x1F, 0x80, 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x81, 0x8B)]] = True

#: Bytes of letters of one or two bytes, U+00C0 to U+023F; two characters of that range are none.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes at which a piece begins, 0 left out: gaps after anything but white space."""
    if len(data) < 2:
        return np.empty(0, np.int64)
    gap = _GAP[data]
    at = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    unsure = at[_UNSURE[data[at - 1]]]
    if not len(unsure):
        return at
    a, b, c = (np.where(unsure >= k, data[np.maximum(unsure - k, 0)], 0) for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    punctuation = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | punctuation | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.setdiff1d(at, unsure[two | three | (c < 0x20)], assume_unique=True)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls being empty."""
    wide = texts.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def groups(texts: pa.Array, most: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(owner, data, at)``: bytes of about ``most`` at a time, the pieces' offsets in them, and each piece's text."""
    data, ends = buffers(texts)
    first, row = int(ends[0]), 0
    while row < len(texts):
        last = int(np.searchsorted(ends, first + most, "right")) - 1
        stop = int(ends[last]) if last > row else None
        if stop is None:  # a text of more than ``most``, or what is left of it
            end = int(ends[row + 1])
            stop = end
            for near in range(first + most, end, most):
                found = cuts(data[near - 4 : min(near + most, end)])
                if len(found := found[found > 3]):  # the bytes before tell what white space is
                    stop = near - 4 + int(found[0])
                    break
        part = data[first:stop]
        rows = np.arange(row, max(last, row + 1))
        inner = ends[row + 1 : max(last, row + 1)] - first
        begin = np.zeros(len(part) + 1, bool)
        begin[cuts(part)] = begin[inner] = begin[0] = True
        at = np.flatnonzero(begin[:-1])
        begins = np.concatenate([[0], inner])
        owner = rows[np.searchsorted(begins, at, "right") - 1] if len(at) else np.empty(0, np.int64)
        yield owner, part, np.append(at, len(part))
        first = stop
        row = max(last, row + (stop == int(ends[row + 1])))


def distinct(part: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and for each piece which it is."""
    n = len(at) - 1
    if n < 1:
        return [], np.empty(0, np.int64)
    every = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(part)])
    coded = every.dictionary_encode()
    return as_bytes(coded.dictionary), coded.indices.to_numpy()


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column without nulls as a list of bytes."""
    data, at = buffers(column)
    blob, first = data[at[0] : at[-1]].tobytes(), int(at[0])
    at = (at - first).tolist()
    return [blob[a:b] for a, b in zip(at, at[1:], strict=False)]


def plain_words(found: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Each piece without the ASCII punctuation at its end, and whether that is a word of letters up to U+023F, perhaps
    after one space or line feed."""
    words = [w.rstrip(MARKS) for w in found]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    good = _LETTER[data]
    if len(data) > 1:
        none = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        good[none] = False
    first = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    at = first[some]
    lead = np.isin(data[at], (10, 32)) & (sizes[some] > 1)
    good[at[lead]] = True
    out = np.zeros(len(words), bool)
    if len(some):
        out[some] = np.logical_and.reduceat(good, at)
    return words, out


def load(path: str):
    """The tokenizer of a .json file, one thread, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Held(dict):
    """Two generations of values of about ``most`` bytes each: what is seen again comes back from the older one.

    ``make`` gives the values of a list of keys.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.size = make, most, 0
        self.old: dict = {}

    def know(self, asked: list[bytes]) -> None:
        """Makes all keys ``asked``, which are distinct, known until the next call."""
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        missing = [k for k in asked if k not in self]
        new = []
        for k in missing:
            if k in self.old:
                self[k] = self.old[k]
            else:
                new.append(k)
        if new:
            self.update(zip(new, self.make(new), strict=True))
        # a key, a value of about its size, and what two small objects and a place in a dict take
        self.size += sum(map(len, missing)) * 2 + 200 * len(missing)


class PieceEncoder:
    """What ``value`` makes of the ids of pieces; frequent pieces are encoded once and held, in memory bounded in bytes.

    Pieces that are one word of Latin letters, perhaps after a space or line feed and before ASCII punctuation, go to
    the library's BPE model directly, as the words that its pre-tokenizer would make of them. All others take the
    whole way, in batches.
    """

    def __init__(self, path: str, value, held: int = 96 << 20):
        self.tokenizer, self.value = load(path), value
        self.model = self.tokenizer.model
        self.rest: dict[bytes, list[int]] = {b"": []}
        self.known = Held(self._make, held)

    def _ids(self, part: bytes) -> list[int]:
        """Ids of what stands before or after a word: few kinds, so these are held."""
        if part not in self.rest:
            if len(self.rest) > 10_000:
                self.rest.clear()
                self.rest[b""] = []
            self.rest[part] = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
        return self.rest[part]

    def _make(self, pieces: list[bytes]) -> list:
        words, plain = plain_words(pieces)
        spelled = b"".join(words).decode("latin-1").translate(_SPELLED)  # a character for each byte
        out, others, at = [], [], 0
        tokenize, value, rest = self.model.tokenize, self.value, self._ids
        for i, (piece, word, direct) in enumerate(zip(pieces, words, plain.tolist(), strict=True)):
            end = at + len(word)
            if not direct:
                others.append(i)
                out.append(None)
            elif word[0] == 10:
                out.append(value(rest(b"\n") + [t.id for t in tokenize(spelled[at + 1 : end])] + rest(piece[len(word) :])))
            elif len(word) == len(piece):
                out.append(value([t.id for t in tokenize(spelled[at:end])]))
            else:
                out.append(value([t.id for t in tokenize(spelled[at:end])] + rest(piece[len(word) :])))
            at = end
        for some in by_size(others, lambda i: len(pieces[i])):
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = value(e.ids)
        return out

    def values(self, asked: list[bytes]) -> list:
        """The values of distinct pieces."""
        self.known.know(asked)
        return list(map(self.known.__getitem__, asked))


def by_size(items: list, size=len, most: int = 1 << 18):
    """Consecutive lists of items of together at most ``most``; a larger item is one of its own."""
    group: list = []
    total = 0
    for x in items:
        n = size(x)
        if group and total + n > most:
            yield group
            group, total = [], 0
        group.append(x)
        total += n
    if group:
        yield group
