"""Word shingles as 64-bit hashes, and fast similarity sketches of their sets."""

from __future__ import annotations

import numpy as np

from .common import LOWER_BYTES, utf8

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text); words are runs of anything but blank and U+0009 to U+000D, A-Z lower-cased."""
    data = [utf8(t).translate(LOWER_BYTES) for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data]) if data else np.empty(0, np.int64)
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    word = np.concatenate(([False], ~_GAP[raw], [False]))
    turns = np.flatnonzero(word[1:] != word[:-1])
    start, end = turns[::2], turns[1::2]
    total = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * _powers(_R, len(raw)))))
    hashes = mix((total[end] - total[start]) * _powers(_R_INVERSE, len(raw) + 1)[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return hashes, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `k`-word shingles; of fewer words the whole sequence is one shingle; no words: an empty set."""
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - k + 1), U)
    for i in range(k):
        rolled = mix(rolled * U(3) + hashes[i : len(hashes) - k + 1 + i] + U(i + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            short = np.full(1, n + 1000, U)
            for h in hashes[at : at + n]:
                short = mix(short * U(3) + h)
            out.append(short)
        else:
            out.append(np.empty(0, U))
        at += n
    return out


EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: `t` coordinates for each set; two sets agree in a coordinate with the chance of their Jaccard similarity.

    In round i every element goes to a bin (rounds below t: a hashed bin, later: bin i - t) with a value that later rounds
    cannot undercut; a coordinate keeps the least value it met. A set leaves once all its bins are filled, after 2t rounds at most.
    """
    out = np.full((len(sets), t), EMPTY, U)
    sizes = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes)
    flat = np.concatenate([sets[i] for i in live]) if len(live) else np.empty(0, U)
    owner = np.repeat(live, sizes[live])
    table = out.reshape(-1)
    for i in range(2 * t):
        if not len(live):
            break
        v = mix(flat + U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bins = ((v >> U(44)) * U(t) >> U(20)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(table, owner * t + bins, (U(i) << U(44)) | (v & U((1 << 44) - 1)))
        if i < 8 or i % 8 == 0:
            done = (out[live] != EMPTY).all(1)
            if done.any():
                keep = np.zeros(len(sets), bool)
                live = live[~done]
                keep[live] = True
                chosen = keep[owner]
                flat, owner = flat[chosen], owner[chosen]
    return out


def bands_for(threshold: float, t: int, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands lose a pair at the threshold with a chance below `miss`."""
    rows = max(r for r in range(1, t + 1) if r == 1 or (1 - threshold**r) ** (t // r) < miss)
    return t // rows, rows


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.tile(np.arange(bands, dtype=U) + U(17), (len(sketch), 1))
    for i in range(rows):
        key = mix(key * U(31) + parts[:, :, i])
    return key
