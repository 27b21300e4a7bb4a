"""CRC-32 of many spans of one byte buffer at once.

CRC-32 is affine over XOR: the checksum of a span is a constant of its length XOR one contribution
per byte, which depends on the byte and on its distance from the span's end alone. Contributions
for distances below ``BLOCK`` are precomputed in a table; a span's are joined by
``bitwise_xor.reduceat``. A longer span is cut, from its end, into blocks of that length. A block
that stands k blocks before the end is its own checksum moved on by k blocks of zero bytes, a linear
map; maps for powers of two are applied for the bits of k, to all blocks at once.
"""

from __future__ import annotations

import numpy as np

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = np.uint32(0xEDB88320)
BLOCK = 64
ONES = np.uint32(0xFFFFFFFF)


def byte_table() -> np.ndarray:
    """What a register of one byte becomes after eight shifts."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ np.where(register & np.uint32(1), POLYNOMIAL, np.uint32(0))
    return register


class Shift:
    """Feeding a number of zero bytes: a linear map of registers, as one table per byte."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def __call__(self, register: np.ndarray) -> np.ndarray:
        out = self.tables[0][register & np.uint32(255)]
        for i in (1, 2, 3):
            out = out ^ self.tables[i][(register >> np.uint32(8 * i)) & np.uint32(255)]
        return out

    def twice(self) -> Shift:
        return Shift(np.stack([self(t) for t in self.tables]))


def powers(first: Shift, count: int) -> list[Shift]:
    out = [first]
    while len(out) < count:
        out.append(out[-1].twice())
    return out


TABLE = byte_table()
# One zero byte, and 2, 4, 8, … of them.
SHIFTS = powers(
    Shift(np.stack([TABLE, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * i - 8) for i in (1, 2, 3)]])), 40
)
BLOCK_SHIFTS = SHIFTS[BLOCK.bit_length() - 1 :]


def position_table() -> np.ndarray:
    """``[distance from the end, byte]`` to its contribution."""
    rows = [TABLE]
    while len(rows) < BLOCK:
        rows.append(SHIFTS[0](rows[-1]))
    return np.stack(rows)


POSITIONS = position_table().ravel()


def moved(register: np.ndarray, steps: np.ndarray, shifts: list[Shift]) -> np.ndarray:
    """Each register after as many steps as given with it."""
    out, bit = register.copy(), 0
    while (steps >> bit).any():
        odd = np.flatnonzero((steps >> bit) & 1)
        out[odd] = shifts[bit](out[odd])
        bit += 1
    return out


LENGTHS = moved(np.full(1024, ONES), np.arange(1024), SHIFTS) ^ ONES


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The checksum of so many zero bytes."""
    long = lengths >= len(LENGTHS)
    out = LENGTHS[np.where(long, 0, lengths)]
    if long.any():
        some = lengths[long]
        out[long] = moved(np.full(len(some), ONES), some, SHIFTS) ^ ONES
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every span. Spans are not empty; they may overlap."""
    if not len(starts):
        return np.empty(0, np.uint32)
    lengths = ends - starts
    upto = np.cumsum(lengths)
    first = upto - lengths
    # Every byte of every span, in order, and its distance from the span's end.
    ramp = np.arange(upto[-1])
    away = np.repeat(upto, lengths) - 1 - ramp
    taken = data[np.repeat(starts - first, lengths) + ramp]
    given = POSITIONS[(away % BLOCK) * 256 + taken]
    if lengths.max() <= BLOCK:
        joined = np.bitwise_xor.reduceat(given, first)
    else:
        blocks = -(-lengths // BLOCK)
        done = np.cumsum(blocks)
        place = np.arange(done[-1]) - np.repeat(done - blocks, blocks)
        head = np.repeat(lengths - (blocks - 1) * BLOCK, blocks)
        begin = np.repeat(first, blocks) + np.where(place, head + (place - 1) * BLOCK, 0)
        parts = np.bitwise_xor.reduceat(given, begin)
        parts = moved(parts, np.repeat(blocks, blocks) - 1 - place, BLOCK_SHIFTS)
        joined = np.bitwise_xor.reduceat(parts, done - blocks)
    return joined ^ length_constants(lengths)
