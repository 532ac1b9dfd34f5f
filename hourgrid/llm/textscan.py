"""Words, lines and their 64-bit hashes for a whole Arrow column of texts at once.

The UTF-8 bytes of a slice of rows are scanned as one numpy array, so the cost per word is a few
vector operations and no Python object is made per word.  A span's hash is a polynomial over its
bytes modulo two primes, read off running sums, and then mixed; it depends on the bytes alone, so equal
spans in different rows, slices and tasks get equal hashes.  (A modulus that is a power of two would not do:
whatever the base, long regular spans such as the Thue-Morse sequence and its complement collide.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes scanned at once.  A single longer text is scanned whole.
SLICE_BYTES = 512 << 10

#: Moduli and bases of the running sums.
_PRIMES = ((2_147_483_647, 1_382_917_039), (2_147_483_629, 947_301_653))
#: Bytes whose terms add up below 2**63 without being reduced one by one.
_SUM_BYTES = 1 << 24
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, for exponents below n."""
    if prime not in _tables or len(_tables[prime][0]) < n:
        made = []
        for step in (base, pow(base, -1, prime)):
            out = np.ones(max(n, SLICE_BYTES + 1), np.uint64)
            done = 1
            while done < len(out):
                more = min(done, len(out) - done)
                out[done: done + more] = out[:more] * np.uint64(pow(step, done, prime)) % np.uint64(prime)
                done += more
            made.append(out)
        _tables[prime] = made[0], made[1]
    return _tables[prime]


class _Sums:
    """Running sums of values times powers, modulo both primes, from which the polynomial of any stretch is read off."""

    def __init__(self, values: np.ndarray, small: bool):
        n = len(values)
        self.n, self.sums = n, []
        for prime, base in _PRIMES:
            powers, _ = _powers(prime, base, n + 1)
            total = np.zeros(n + 1, np.uint64)
            if small and n <= _SUM_BYTES:
                np.cumsum(values * powers[:n], out=total[1:])
            else:
                np.cumsum(values % np.uint64(prime) * powers[:n] % np.uint64(prime), out=total[1:])
            self.sums.append(total)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62 bits for the stretches [start, end), mixed with their lengths."""
        out = np.zeros(len(start), np.uint64)
        for (prime, base), total in zip(_PRIMES, self.sums):
            _, inverse = _powers(prime, base, self.n + 1)
            out = (out << np.uint64(31)) | (total[end] - total[start]) % np.uint64(prime) * inverse[start] % np.uint64(prime)
        return mix(out + mix((end - start).astype(np.uint64)))


def sequence_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the stretches first[0]:first[1], first[1]:first[2], ... of 64-bit values."""
    return _Sums(values, False).of(first[:-1], first[1:])


@dataclass
class Scan:
    """A slice of rows: ``data`` its bytes, ``row_start`` (rows + 1) the offsets of its texts."""

    data: np.ndarray
    row_start: np.ndarray

    def __post_init__(self):
        self._sum = None

    @property
    def rows(self) -> int:
        return len(self.row_start) - 1

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans [start, end)."""
        if self._sum is None:
            self._sum = _Sums(self.data.astype(np.uint64) + np.uint64(1), True)
        return self._sum.of(start, end)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the row it lies in; words never cross rows."""
        edge = np.zeros(len(self.data) + 1, bool)
        inside = ~_SPACE[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts_here = self.row_start[:-1][self.row_start[:-1] < self.row_start[1:]]
        first[starts_here] = inside[starts_here]
        edge[:-1] = ~inside
        edge[starts_here] = True
        edge[len(self.data)] = True
        start = np.flatnonzero(first)
        stops = np.flatnonzero(edge)
        end = stops[np.searchsorted(stops, start, side="right")] if len(start) else start
        return start, end, self.row_of(start)

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row_start, position, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start and end of every piece between \n, and its row; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.row_start[:-1], breaks + 1])
        rank = np.concatenate([np.zeros(self.rows, np.int64), np.ones(len(breaks), np.int64)])
        row = np.concatenate([np.arange(self.rows), self.row_of(breaks)])
        order = np.lexsort((rank, start, row))
        start, row = start[order], row[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.ones(len(start), bool)
        last[:-1] = row[1:] != row[:-1]
        end[last] = self.row_start[row[last] + 1]
        return start, end, row


def lowered(scan: Scan) -> Scan:
    """The same rows with A-Z in lower case."""
    return Scan(_LOWER[scan.data], scan.row_start)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Scan]]:
    """The texts of a column in slices of about ``limit`` bytes, each with its first row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may stand over bytes that nobody wrote
        length = np.where(np.asarray(column.is_null()), 0, np.diff(at))
    else:
        length = np.diff(at)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        kept = length[first:last]
        if (kept == np.diff(at[first: last + 1])).all():
            part = data[at[first]: at[last]]
        else:
            part = np.concatenate([data[at[i]: at[i] + length[i]] for i in range(first, last)])
        yield first, Scan(part, np.concatenate([[0], np.cumsum(kept)]))
        first = last


def windows(word_hash: np.ndarray, word_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n successive words (a few) that begin at each word, and where they stay in one row."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * _STEP + word_hash[i: i + count]
    first = np.flatnonzero(word_row[:count] == word_row[n - 1: n - 1 + count])
    return mix(total[first]), first


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def per_row(row: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weight, minlength=rows).astype(np.int64)
