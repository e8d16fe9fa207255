"""Words, word hashes and repeated runs of a text, in numpy over its UTF-8 bytes.

Every function works on one text inside a task. Hashes are 64-bit and the same in every process. A text is cut into
words piece by piece, so that the arrays over its bytes stay small however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 20
_SPACES = bytes([0x20, *range(0x09, 0x0E)])

SPACED = np.ones(256, dtype=bool)
SPACED[list(_SPACES)] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def _byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


CODES = _byte_codes()
FOLDED = CODES.copy()
FOLDED[0x41:0x5B] = CODES[0x61:0x7B]


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            steps = np.full(size + 1, _BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = _Powers()


def prefixes(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit codes; ``between`` reads the hash of any run from them."""
    up, _ = _POWERS.upto(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), equal for equal runs wherever they are."""
    _, down = _POWERS.upto(len(sums) - 1)
    return mixed((sums[end] - sums[start]) * down[start])


def word_spans(data: bytes, letters: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``letters`` allows."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = letters[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, letters: np.ndarray = SPACED, codes: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hash of each word in order; with ``FOLDED``, A-Z counts as a-z."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and letters[data[end]] and letters[data[end - 1]]:
            end += 1
        piece = data[at:end]
        starts, ends = word_spans(piece, letters)
        found.append(between(prefixes(codes[np.frombuffer(piece, dtype=np.uint8)]), starts, ends))
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` consecutive values; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    start = np.arange(len(words) - n + 1)
    return between(prefixes(words), start, start + n)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` consecutive ones."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def covered(starts: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the runs [start, start + width)."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def seen_again(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, cut so that no group of equal (integer) ``names`` is torn apart."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        same = np.ones(joined.num_rows, dtype=bool)
        for name in names:
            column = joined.column(name).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        others = np.flatnonzero(~same)
        cut = int(others[-1]) + 1 if len(others) else 0
        rest = joined.slice(cut)
        if cut:
            yield joined.slice(0, cut)
    if rest is not None:
        yield rest
