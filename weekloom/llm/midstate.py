"""SHA-256 over columns of numpy arrays, with the state between two blocks in the open.

A library hash object keeps its state to itself; here a state is eight 32-bit words that can be copied, written
to a table and resumed in another task. Arrays have a column for each hash: states are (8, n), blocks (16, n).
A digest as hex text is 64 bytes, one block exactly, so every state of a parent falls on a block border.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _root_bits(power: int, n: int) -> list[int]:
    """First 32 bits of the fractional parts of the square (2) or cube (3) roots of the first ``n`` primes."""
    primes = [p for p in range(2, 320) if all(p % d for d in range(2, isqrt(p) + 1))][:n]
    out = []
    for p in primes:
        low, high, goal = 0, p << 32, p << (32 * power)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**power <= goal else (low, mid - 1)
        out.append(low & 0xFFFFFFFF)
    return out


START = np.array(_root_bits(2, 8), np.uint32)
ROUND = [np.uint32(k) for k in _root_bits(3, 64)]
#: Four hex digits of a 16-bit number as the bytes of a word.
HEX = np.frombuffer("".join(f"{v:04x}" for v in range(1 << 16)).encode(), ">u4").astype(np.uint32)
#: Columns of one numpy pass, small enough for a core's cache.
SLICE = 4096


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(
            w[i - 16]
            + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
            + w[i - 7]
            + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
        )
    a, b, c, d, e, f, g, h = state
    for k, word in zip(ROUND, w):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + k + word
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block each."""
    n = state.shape[1]
    block = np.broadcast_to(block, (16, n))
    cuts = range(0, n, SLICE)
    parts = [_compress(state[:, i : i + SLICE], block[:, i : i + SLICE]) for i in cuts]
    return np.concatenate(parts, 1) if parts else state


def fresh(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, 1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The blocks that digests (8, n) fill as hex text."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2], out[1::2] = HEX[digest >> np.uint32(16)], HEX[digest & np.uint32(0xFFFF)]
    return out


def last_block(blocks: np.ndarray) -> np.ndarray:
    """The closing blocks of messages of so many whole blocks."""
    out = np.zeros((16, len(blocks)), np.uint32)
    out[0], bits = 0x80000000, blocks.astype(np.uint64) * np.uint64(512)
    out[14], out[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` whole blocks that led to ``state``."""
    return compress(state, last_block(blocks))


def from_bytes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32)


def to_bytes(digest: np.ndarray) -> list[bytes]:
    raw = digest.T.astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]
