"""A compressed full-text index of a shard of short records, searched backwards for many patterns at once.

Pure helper: it runs inside tasks on one bounded shard; Spark decides which patterns meet which shard.
"""

from __future__ import annotations

import io

import numpy as np

#: Symbols: 0 ends a record, 1..16 are hexadecimal digits, further ones name the kind of a field.
SEPARATOR, DIGIT, KIND_PLACE, KIND_ID = 0, 1, 17, 18
SIGMA = 19
#: Occurrences are stored once per block of this many symbols and counted within a block on demand.
BLOCK = 32


def digits(values: np.ndarray, n: int) -> np.ndarray:
    """The n hexadecimal digits of non-negative integers as symbols, the least significant first."""
    shifts = np.arange(n, dtype=np.uint64) * np.uint64(4)
    return ((values.astype(np.uint64)[:, None] >> shifts) & np.uint64(15)).astype(np.uint8) + DIGIT


def place_symbols(cx: np.ndarray, cy: np.ndarray, n: int = 5) -> np.ndarray:
    """Interleaved digits of a cell, least significant first and the kind last, so that a backward search narrows from coarse to fine."""
    both = np.empty((len(cx), 2 * n + 1), np.uint8)
    both[:, 0 : 2 * n : 2], both[:, 1 : 2 * n : 2] = digits(cx, n), digits(cy, n)
    both[:, -1] = KIND_PLACE
    return both


def id_symbols(ids: np.ndarray, n: int = 16) -> np.ndarray:
    out = np.empty((len(ids), n + 1), np.uint8)
    out[:, :n], out[:, -1] = digits(ids.view(np.uint64) if ids.dtype == np.int64 else ids, n), KIND_ID
    return out


class FMIndex:
    """Burrows-Wheeler transform with block counts, and the record number of every record start."""

    def __init__(self, bwt: np.ndarray, counts: np.ndarray, first: np.ndarray, records: np.ndarray):
        self.bwt, self.counts, self.first, self.records = bwt, counts, first, records

    @classmethod
    def build(cls, tables: list[np.ndarray]) -> FMIndex:
        """From matrices of symbols, one record a row; records are numbered through all tables."""
        parts, starts, at = [], [], 0
        for t in tables:
            text = np.zeros((t.shape[0], t.shape[1] + 1), np.uint8)  # each record follows a separator
            text[:, 1:] = t
            starts.append(at + np.arange(t.shape[0], dtype=np.int64) * text.shape[1])
            parts.append(text.ravel())
            at += text.size
        text = np.concatenate([*parts, np.zeros(1, np.uint8)])
        order = cls._suffixes(text)
        bwt = text[order - 1]
        start = np.full(len(text), -1, np.int64)
        begins = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        start[begins] = np.arange(len(begins))
        records = start[order[: int((text == SEPARATOR).sum())]].astype(np.int32)
        padded = np.full(-(-(len(bwt) + 1) // BLOCK) * BLOCK, 255, np.uint8)
        padded[: len(bwt)] = bwt
        blocks = padded.reshape(-1, BLOCK)
        per = np.stack([(blocks == s).sum(axis=1) for s in range(SIGMA)], axis=1)
        counts = np.zeros((len(blocks) + 1, SIGMA), np.int32)
        counts[1:] = np.cumsum(per, axis=0)
        first = np.concatenate([[0], np.cumsum(counts[-1])]).astype(np.int64)
        return cls(padded, counts, first, records)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; records are short, so few rounds decide."""
        rank = text.astype(np.int64)
        n, k = len(text), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            if new.max() == n - 1 or k >= n:
                return order
            rank, k = new, k * 2

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        block, within = np.divmod(at, BLOCK)
        inside = self.bwt.reshape(-1, BLOCK)[np.minimum(block, len(self.bwt) // BLOCK - 1)] == symbol[:, None]
        inside &= np.arange(BLOCK) < within[:, None]
        return self.counts[block, symbol] + inside.sum(axis=1)

    def search(self, patterns: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length): the rows of the longest suffix of each pattern that occurs, and its length.

        A pattern is read from its last symbol on; it stays at its maximal match once a symbol more would not occur.
        """
        lows, highs, lengths = [], [], []
        for i in range(0, len(patterns), step):
            p = patterns[i : i + step]
            n = len(p)
            low, high = np.zeros(n, np.int64), np.full(n, int(self.first[-1]), np.int64)
            length = np.zeros(n, np.int32)
            alive = np.arange(n)
            for j in range(p.shape[1] - 1, -1, -1):
                c = p[alive, j].astype(np.int64)
                a = self.first[c] + self._rank(c, low[alive])
                b = self.first[c] + self._rank(c, high[alive])
                found = b > a
                alive = alive[found]
                low[alive], high[alive] = a[found], b[found]
                length[alive] += 1
                if not len(alive):
                    break
            lows.append(low), highs.append(high), lengths.append(length)
        if not lows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(lows), np.concatenate(highs), np.concatenate(lengths)

    def records_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, record) for rows of patterns matched up to a separator, where each row is a record's start."""
        n = high - low
        pattern = np.repeat(np.arange(len(low)), n)
        row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return pattern, self.records[row]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, bwt=self.bwt, counts=self.counts, first=self.first, records=self.records)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["bwt"], z["counts"], z["first"], z["records"])
