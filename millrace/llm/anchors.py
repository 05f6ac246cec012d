"""Covering codes for Hamming space: Hamming codes, anchors, and thinning of links.

A perfect code of 2^m - 1 bits covers every word within one flipped bit of exactly one code word.
Bits of a block beyond the code's take all their values, so the anchors of a block cover it with radius 1.
"""

from __future__ import annotations

import itertools

import numpy as np


def syndrome(words: np.ndarray, code_bits: int) -> np.ndarray:
    """XOR of the 1-based places of the set bits among the low ``code_bits`` bits; 0 for code words."""
    out = np.zeros(words.shape, np.uint64)
    for place in range(code_bits):
        out ^= ((words >> np.uint64(place)) & np.uint64(1)) * np.uint64(place + 1)
    return out


def flips(bits: int, code_bits: int, reach: int) -> list[np.ndarray]:
    """For each syndrome, the flips of at most ``reach`` of ``bits`` bits that lead from such a word to an anchor."""
    found = np.array([sum(1 << i for i in c) for n in range(reach + 1) for c in itertools.combinations(range(bits), n)], np.uint64)
    leads = syndrome(found & np.uint64((1 << code_bits) - 1), code_bits)
    return [found[leads == s] for s in range(code_bits + 1)]


def anchors_of(words: np.ndarray, blocks: tuple[tuple[int, int], ...], code_bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``(cell, index into words)`` of all anchors within ``reach`` bits in each block ``(shift, bits)``; a cell's high half is the block."""
    cells, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, (shift, bits) in enumerate(blocks):
        part = (words >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        found = syndrome(part & np.uint64((1 << code_bits) - 1), code_bits)
        for s, masks in enumerate(flips(bits, code_bits, reach)):
            own = np.flatnonzero(found == s)
            if len(own) and len(masks):
                cells.append((part[own][:, None] ^ masks[None, :]).ravel().astype(np.int64) | (number << 32))
                rows.append(np.repeat(own, len(masks)))
    return np.concatenate(cells), np.concatenate(rows)


def home_of(words: np.ndarray, blocks: tuple[tuple[int, int], ...], code_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(cell, index into words)`` of the nearest anchor in each block: one code bit is flipped at most."""
    cells = []
    for number, (shift, bits) in enumerate(blocks):
        part = (words >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        found = syndrome(part & np.uint64((1 << code_bits) - 1), code_bits)
        flip = np.where(found > 0, np.uint64(1) << np.maximum(found, np.uint64(1)) - np.uint64(1), np.uint64(0))
        cells.append((part ^ flip).astype(np.int64) | (number << 32))
    return np.concatenate(cells), np.tile(np.arange(len(words)), len(blocks))


def thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as ``a - b``, fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        if not (la != lb).any():
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows with equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        changed |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], changed]))


def spread(start: np.ndarray, count: np.ndarray, most: int):
    """Yields ``(owner, member)`` over the ranges ``start .. start + count`` of all owners, about ``most`` pairs at a time."""
    total = np.concatenate([[0], np.cumsum(count)])
    for k in range(0, int(total[-1]), most):
        end = min(int(total[-1]), k + most)
        lo, hi = np.searchsorted(total, [k, end - 1], side="right") - 1
        own = np.arange(lo, hi + 1)
        size = np.minimum(total[own + 1], end) - np.maximum(total[own], k)
        owner = np.repeat(own, size)
        yield owner, start[owner] + np.arange(k, end) - total[owner]
