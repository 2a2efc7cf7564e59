"""Ribbon filters over 64-bit key hashes, in numpy.

A filter holds, for a set of keys, the solution of a banded system of linear equations over GF(2): each
key gives one equation whose coefficients are a 64-bit band at a hashed start, and whose right side is
an 8-bit fingerprint. A key of the set always satisfies its equation; any other key does with
probability 2**-8. A set is cut into blocks of some 512 keys, and all blocks are eliminated side by
side, each advancing on its own, so that a numpy step serves every block at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BAND = 64  # width of the band, bits
FINGERPRINT_BITS = 8
BLOCK_KEYS = 512  # keys a block holds on average
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((_mix(h ^ _U(0x9E3779B97F4A7C15)) >> _U(32)) * _U(n_blocks) >> _U(32)).astype(np.int64)


def _equation(h: np.ndarray, seed: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, band and fingerprint of each key under its block's seed."""
    a = _mix(h + (seed.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))
    b = _mix(a ^ _U(0x8CB92BA72F3D8DD7))
    start = ((a >> _U(32)) * _U(rows - BAND + 1) >> _U(32)).astype(np.int64)
    return start, b | _U(1), (_mix(a + b) & _U(0xFF)).astype(np.uint8)


def _ctz(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64)


@dataclass
class Ribbon:
    """A solved filter: ``solution`` is (blocks, rows) of fingerprint bytes."""

    n_keys: int
    seeds: np.ndarray
    solution: np.ndarray

    def to_bytes(self) -> bytes:
        head = np.array([self.n_keys, *self.solution.shape], dtype=np.int64)
        return head.tobytes() + self.seeds.astype(np.uint32).tobytes() + self.solution.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Ribbon:
        n, blocks, rows = (int(v) for v in np.frombuffer(data, np.int64, 3))
        seeds = np.frombuffer(data, np.uint32, blocks, 24)
        return Ribbon(n, seeds, np.frombuffer(data, np.uint8, blocks * rows, 24 + 4 * blocks).reshape(blocks, rows))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """True for every key of the set, and by chance for one other key in 2**8."""
        h = np.asarray(hashes).astype(np.int64).view(_U)
        if not self.n_keys or not len(h):
            return np.zeros(len(h), bool)
        blocks, rows = self.solution.shape
        block = _block_of(h, blocks)
        start, band, want = _equation(h, self.seeds[block], rows)
        flat, at = self.solution.ravel(), block * rows + start
        got = np.zeros(len(h), np.uint8)
        for j in range(BAND):
            got ^= flat[at + j] * ((band >> _U(j)) & _U(1)).astype(np.uint8)
        return got == want


def _eliminate(h: np.ndarray, block: np.ndarray, n_blocks: int, seeds: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangular rows and right sides of each block, and which blocks came out contradictory."""
    start, band, right = _equation(h, seeds[block], rows)
    order = np.lexsort((start, block))
    start, band, right = start[order], band[order], right[order]
    count = np.bincount(block, minlength=n_blocks)
    nxt = np.concatenate(([0], np.cumsum(count)[:-1]))
    stop = nxt + count
    coeff, value = np.zeros(n_blocks * rows, _U), np.zeros(n_blocks * rows, np.uint8)
    failed = np.zeros(n_blocks, bool)
    live = np.flatnonzero(count)
    s, c, r = start[nxt[live]], band[nxt[live]], right[nxt[live]]
    base, nxt, stop = live * rows, nxt[live], stop[live]
    while len(live):
        at = base + s
        there = coeff[at]
        free = there == 0
        coeff[at[free]], value[at[free]] = c[free], r[free]
        held = ~free
        c = np.where(held, c ^ there, c)
        r = np.where(held, r ^ value[at], r)
        gone = held & (c == 0)
        failed[live[gone & (r != 0)]] = True
        moves = held & ~gone
        shift = np.where(moves, _ctz(np.where(c == 0, _U(1), c)), 0)
        s, c = s + shift, c >> shift.astype(_U)
        done = ~moves  # placed, or an equation that says nothing new: on to the block's next key
        nxt = nxt + done
        more = (nxt < stop) & ~failed[live]
        load = done & more
        s[load], c[load], r[load] = start[nxt[load]], band[nxt[load]], right[nxt[load]]
        if not more.all():
            live, base, nxt, stop, s, c, r = (x[more] for x in (live, base, nxt, stop, s, c, r))
    return coeff.reshape(n_blocks, rows), value.reshape(n_blocks, rows), failed


def _solve(coeff: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Back substitution, all blocks and fingerprint columns at once; free rows get 0."""
    blocks, rows = coeff.shape
    out = np.zeros((blocks, rows), np.uint8)
    window = np.zeros((blocks, FINGERPRINT_BITS), _U)  # bit j: the column's solution j rows further down
    bits = np.arange(FINGERPRINT_BITS, dtype=np.uint8)
    for i in range(rows - 1, -1, -1):
        window <<= _U(1)
        c = coeff[:, i]
        bit = (np.bitwise_count(window & c[:, None]) & 1) ^ ((value[:, i, None] >> bits) & 1)
        bit[c == 0] = 0
        window |= bit.astype(_U)
        out[:, i] = (bit << bits).sum(axis=1, dtype=np.uint8)
    return out


def build(hashes: np.ndarray) -> Ribbon:
    """The filter of distinct 64-bit hashes. A block whose system has no solution is tried again under
    the next seed; after every eighth round the blocks get more rows."""
    h = np.unique(np.asarray(hashes).astype(np.int64)).view(_U)
    if not len(h):
        return Ribbon(0, np.zeros(1, np.uint32), np.zeros((1, BAND), np.uint8))
    n_blocks = max(1, round(len(h) / BLOCK_KEYS))
    block = _block_of(h, n_blocks)
    slack = 1.08
    most = int(np.bincount(block).max())
    seeds = np.zeros(n_blocks, np.uint32)
    while True:
        rows = int(most * slack) + BAND
        coeff, value, failed = _eliminate(h, block, n_blocks, seeds, rows)
        for _ in range(8):
            if not failed.any():
                return Ribbon(len(h), seeds, _solve(coeff, value))
            seeds[failed] += 1
            again = failed[block]
            ids = np.flatnonzero(failed)
            new = np.searchsorted(ids, block[again])
            c2, v2, f2 = _eliminate(h[again], new, len(ids), seeds[ids], rows)
            coeff[ids], value[ids] = c2, v2
            failed = np.zeros(n_blocks, bool)
            failed[ids[f2]] = True
        slack *= 1.1
