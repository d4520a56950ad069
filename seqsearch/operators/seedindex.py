"""An index of queries' seeds, and what a run of subjects hits in it: numpy over whole Arrow batches.

A k-mer is a number, and a table addressed by it gives its places in the queries. Hits of subjects laid one after the
other are made a bounded number at a time and counted by (query, subject, bin). A later place in a subject can only vote
for later bins, so all bins before the present place are complete and leave at once; what is held doesn't grow with a subject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.scoring import BIN

#: Hits that are made at a time: about 100 bytes each while they are counted.
HITS = 1 << 21
#: Places of subjects that are looked up at a time.
PLACES = 1 << 18
_OTHER = 26


def _code(text: np.ndarray) -> np.ndarray:
    """Bytes as 0 to 25 for A to Z; all others are 26."""
    code = text.astype(np.int32) - 65
    code[(code < 0) | (code > 25)] = _OTHER
    return code


def _ascii(text: str) -> bytes:
    return text.encode("ascii", "replace")


class SeedIndex:
    """Seeds of ``sequences``: letters A to Z only (unless ``illegal``) and not one letter ``k`` times; with
    ``blank_tail_a`` none of three equal letters before A's. ``least``: votes that make a candidate, for each query."""

    def __init__(self, sequences: list[str], k: int, illegal: bool = False, blank_tail_a: bool = False, least: list[int] | None = None):
        self.k, self.illegal, self.base = k, illegal, 27 if illegal else 26
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.least = np.array(least, np.int64) if least is not None else None
        data = np.frombuffer(b"".join(map(_ascii, sequences)), np.uint8)
        ends = np.cumsum(self.lengths)
        code, good = self.seeds(data, ends)
        if blank_tail_a:
            for i in range(26):
                good &= code != sum(x * self.base ** (k - 1 - j) for j, x in enumerate([i] * 3 + [0] * (k - 3)))
        at = np.flatnonzero(good)
        order = np.argsort(code[at], kind="stable")
        at = at[order]
        self.query = np.searchsorted(ends, at, "right").astype(np.int32)
        self.position = (at - (ends - self.lengths)[self.query]).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code[at], minlength=self.base**k), dtype=np.int64)]).astype(np.int32)

    def seeds(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the k-mer at each place, and whether it may be a seed."""
        n, k = len(data), self.k
        if n < k:
            return np.zeros(n, np.int32), np.zeros(n, bool)
        x = _code(data)
        code = x[: n - k + 1].copy()
        for i in range(1, k):
            code *= self.base
            code += x[i : n - k + 1 + i]
        good = np.zeros(n, bool)
        # one letter k times is that letter's number times 11...1 in this base
        good[: n - k + 1] = code != x[: n - k + 1] * sum(self.base**i for i in range(k))
        last = (ends[:, None] - np.arange(1, k)).ravel()
        good[last[last >= 0]] = False  # no room to the sequence's end
        if not self.illegal:
            other = (np.flatnonzero(x == _OTHER)[:, None] - np.arange(k)).ravel()
            good[other[other >= 0]] = False
        return np.append(code, np.zeros(k - 1, np.int32)), good

    def _runs(self, code: np.ndarray, good: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """``(places, postings, next place)``: hits in the order of places, about ``HITS`` at a time."""
        for begin in range(0, len(code), PLACES):
            end = min(begin + PLACES, len(code))
            at = begin + np.flatnonzero(good[begin:end])
            first = self.first[code[at]]
            n = self.first[code[at] + 1] - first
            at, first, n = at[n > 0], first[n > 0], n[n > 0]
            ends, done = np.cumsum(n, dtype=np.int64), 0
            while done < len(at):
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
                some = n[done:stop]
                before = np.repeat(np.cumsum(some, dtype=np.int64) - some - first[done:stop], some)
                yield np.repeat(at[done:stop], some), np.arange(len(before)) - before, end if stop == len(at) else int(at[stop])
                done = stop
            if not len(at):
                yield at, at, end

    def hits(self, data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, place in it, subject, place in it)`` of all hits, by their numbers in the two lists."""
        ends = np.cumsum(lengths)
        code, good = self.seeds(data, ends)
        for at, post, _ in self._runs(code, good):
            subject = np.searchsorted(ends, at, "right")
            yield self.query[post], self.position[post], subject, at - (ends - lengths)[subject]

    def votes(self, data: np.ndarray, lengths: np.ndarray, origin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, subject, bin, votes)``: hits counted by bins of diagonals, those with enough votes where ``least`` is
        known. ``origin``: where each subject's places count from."""
        if not len(self.position) or not len(data):
            return
        ends = np.cumsum(lengths)
        begins = ends - lengths
        code, good = self.seeds(data, ends)
        # bins of all subjects side by side; each subject has as many as any query can reach
        room = (lengths + int(self.lengths.max()) + 2 * BIN) // BIN + 1
        base = np.cumsum(room) - room
        total, small = int(room.sum()), origin % BIN
        # a hit's key is its query's number times the bins of all subjects, and its bin among these: what a posting, the place and
        # the subject add to its eightfold
        of_posting = self.query.astype(np.int64) * (total * BIN) + self.lengths[self.query] - self.position
        of_subject = base * BIN + small - begins
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def counted(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            if counts is None:
                keys.sort()
            else:
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
            first = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)[: len(keys)]
            return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts

        def made(keys: np.ndarray, counts: np.ndarray):
            query, rest = np.divmod(keys, total)
            if self.least is not None:
                enough = counts >= self.least[query]
                query, rest, counts = query[enough], rest[enough], counts[enough]
            subject = np.searchsorted(base, rest, "right") - 1
            return query, subject, rest - base[subject] + origin[subject] // BIN, counts

        for at, post, following in self._runs(code, good):
            found = of_posting[post]
            found += at
            found += np.repeat(of_subject, np.diff(np.searchsorted(at, ends), prepend=0))
            found >>= BIN.bit_length() - 1
            new, n = counted(found, None)
            if len(keys):
                keys, counts = counted(np.concatenate([keys, new]), np.concatenate([counts, n]))
            else:
                keys, counts = new, n
            if following < len(data):
                s = int(np.searchsorted(ends, following, "right"))
                complete = keys % total < base[s] + (following - begins[s] + small[s] + self.k) // BIN
            else:
                complete = np.ones(len(keys), bool)
            if complete.any():
                yield made(keys[complete], counts[complete])
                keys, counts = keys[~complete], counts[~complete]
        if len(keys):
            yield made(keys, counts)
