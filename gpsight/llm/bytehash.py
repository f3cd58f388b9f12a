"""Hashes of byte strings that start at every position of a buffer."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def words64(data: bytes) -> np.ndarray:
    """The 8 bytes from each position of ``data`` as a number (zeros beyond its end)."""
    padded = np.frombuffer(data + bytes(16), np.uint8)
    out = np.empty(len(data) + 8, np.uint64)
    whole = len(out) // 8
    for shift in range(8):
        view = padded[shift:shift + 8 * whole].view("<u8")
        part = out[shift::8]
        part[:] = view[:len(part)] if len(part) <= len(view) else np.append(view, np.zeros(len(part) - len(view), np.uint64))
    return out[:len(data)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_ODD[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(_ODD[1])
    x ^= x >> np.uint64(29)
    return x


def hash_at(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (8 or more) from each position; valid where they lie inside."""
    n = max(0, len(words) - size + 1)
    out = mixed(words[:n])
    for number, at in enumerate([*range(8, size - 7, 8), *([size - 8] if size % 8 else [])]):
        out = mixed(out * np.uint64(_ODD[2]) + words[at:at + n] * np.uint64(_ODD[3]) + np.uint64(number + 1))
    return out


def sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``size`` values, by doubling."""
    done, width = x, 1
    while 2 * width <= size:
        done = pick(done[:-width], done[width:]) if len(done) > width else done[:0]
        width *= 2
    rest = size - width
    if rest and len(done):
        done = pick(done[:-rest], done[rest:]) if len(done) > rest else done[:0]
    return done
