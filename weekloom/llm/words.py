"""Words of many texts at once: positions and 64-bit hashes with numpy, for use inside tasks.

Both word classes of the contracts are classes of UTF-8 bytes, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are handled in one numpy pass; one longer text is a pass of its own.
PASS_BYTES = 500_000

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
NOT_SPACE = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
LETTERS = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_bytes >= 128)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            with np.errstate(over="ignore"):
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (byte + 1) * BASE**k over k in [i, j)."""
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever it stands."""
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a pass: ``data`` (lower-cased bytes), ``start`` / ``end``, ``hash``; text k has words cut[k]..cut[k+1]."""

    def __init__(self, texts: list[bytes], letters: np.ndarray) -> None:
        self.raw = b" ".join(texts) + b" "
        self.data = LOWER[np.frombuffer(self.raw, np.uint8)]
        inside = letters[self.data].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.cut = np.searchsorted(self.start, self.offset)
        self.hash = hashes(prefix_sums(self.data), self.start, self.end)


def passes(texts: pa.Array | list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in slices of about PASS_BYTES; null is empty.

    Of an Arrow column only one slice at a time is turned into Python objects.
    """
    if isinstance(texts, list):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        cut = lambda a, b: texts[a:b]
    else:
        column = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = lambda a, b: [t or b"" for t in column.slice(a, b - a).to_pylist()]
    upto = np.cumsum(sizes + 1)
    at = 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + PASS_BYTES, "right")))
        yield at, cut(at, end)
        at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; only a group that is not over yet is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        first_of_last = int(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1])
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if first_of_last:
            yield pa.Table.from_batches([*held, batch.slice(0, first_of_last)])
            held = []
        held.append(batch.slice(first_of_last))
    if held:
        yield pa.Table.from_batches(held)


def group_cuts(keys: np.ndarray) -> np.ndarray:
    """Group borders, both ends included, of sorted keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)
