"""Directly addressable codes for integer sequences.

Each number is cut into byte-wide chunks, lowest first.  Level 0 holds the
first chunk of every number and one continuation bit each; level 1 the second
chunk of those whose bit is set, and so on.  A rank directory over each bitmap
turns a position on one level into the position on the next, so any number is
read with one look-up a level and nothing else is decoded.

Layout, little-endian: ``DAC1``, count (u32), levels (u32); then per level its
count (u32), the chunks, the bitmap (bit i in byte i // 8, bit i % 8) padded to
whole blocks of 512 bits, and one u32 a block: the set bits before it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK_BITS = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)


def encode(values) -> bytes:
    rest = np.asarray(values, dtype=np.uint32)
    out, levels, n = [], 0, len(rest)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), dtype=np.uint8)])
        per = _ONES[bits].reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32)
        rank = (np.cumsum(per, dtype=np.uint32) - per).astype("<u4")
        out += [struct.pack("<I", len(rest)), rest.astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    return b"".join([MAGIC, struct.pack("<II", n, levels), *out])


def _levels(blob):
    """(chunks, bitmap, rank) of each level, as views of the blob."""
    if bytes(blob[:4]) != MAGIC:
        raise ValueError("not a DAC1 block")
    n, levels = struct.unpack_from("<II", blob, 4)
    at, out = 12, []
    for _ in range(levels):
        m, = struct.unpack_from("<I", blob, at)
        blocks = -(-m // BLOCK_BITS)
        chunks = np.frombuffer(blob, np.uint8, m, at + 4)
        bits = np.frombuffer(blob, np.uint8, blocks * BLOCK_BITS // 8, at + 4 + m)
        rank = np.frombuffer(blob, "<u4", blocks, at + 4 + m + len(bits))
        out.append((chunks, bits, rank))
        at += 4 + m + len(bits) + 4 * blocks
    return n, out


def count(blob) -> int:
    return struct.unpack_from("<I", blob, 4)[0]


def decode(blob) -> np.ndarray:
    n, levels = _levels(blob)
    out, where = np.zeros(n, dtype=np.uint32), np.arange(n)
    for k, (chunks, bits, _) in enumerate(levels):
        out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
        where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
    return out


def access(blob, positions) -> np.ndarray:
    """The numbers at ``positions`` (an array), by rank alone."""
    n, levels = _levels(blob)
    p = np.asarray(positions, dtype=np.int64)
    if len(p) and (p.min() < 0 or p.max() >= n):
        raise IndexError("position outside the block")
    out, alive = np.zeros(len(p), dtype=np.uint32), np.arange(len(p))
    for k, (chunks, bits, rank) in enumerate(levels):
        out[alive] |= chunks[p].astype(np.uint32) << np.uint32(8 * k)
        on = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
        alive, p = alive[on], p[on]
        if not len(p):
            break
        block = p // BLOCK_BITS
        within = bits.reshape(-1, BLOCK_BITS // 8)[block]
        before = np.arange(BLOCK_BITS // 8)[None, :]
        byte, bit = (p % BLOCK_BITS >> 3)[:, None], (p & 7)[:, None]
        mask = np.where(before < byte, 255, np.where(before == byte, (1 << bit) - 1, 0)).astype(np.uint8)
        p = rank[block].astype(np.int64) + _ONES[within & mask].sum(axis=1, dtype=np.int64)
    return out
