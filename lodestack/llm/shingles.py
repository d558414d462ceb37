"""Hashed word shingles of many texts at once, by array operations on their bytes."""

from __future__ import annotations

import numpy as np

from .chunks import mix
from .common import SPACE_BYTES

SPACES = np.zeros(256, bool)
SPACES[list(SPACE_BYTES)] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, the len + 1 offsets of each text's words). A word is a run of bytes that are no white space."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACES[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[0] = True
    fresh[1:-1] = ~solid[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(solid & fresh[:-1])
    body = data[solid].astype(np.uint64)
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    rank = np.cumsum(solid) - 1
    first = rank[starts]
    lens = np.diff(np.r_[first, len(body)])
    at = np.arange(len(body)) - np.repeat(first, lens)
    powers = np.cumprod(np.full(int(lens.max()), BASE, np.uint64))
    body += np.uint64(1)
    body *= powers[at]
    return mix(np.add.reduceat(body, first)), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, the len + 1 offsets of each text's shingles). A text of fewer words has one shingle, of none none."""
    n = np.diff(ends)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes))
    last = ends[1:][text]
    keep = (at + size <= last) | (at == ends[:-1][text])
    at, last = at[keep], last[keep]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = mix(out + np.where(at + k < last, padded[at + k], np.uint64(k + 1)))
    return out, np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(n)))])
