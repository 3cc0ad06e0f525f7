"""CRC-32C of record shards, by lanes: pieces of a payload side by side, then put together by the shift of a piece's length."""

from __future__ import annotations

import functools

import numpy as np

#: The reflected Castagnoli polynomial, and what a stored checksum is rotated and raised by.
POLYNOMIAL, RAISED = 0x82F63B78, 0xA282EAD8
_LANE = 512


@functools.cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


@functools.cache
def _shift(n: int) -> np.ndarray:
    """Four tables of 256: what n zero bytes make of each byte of a state."""
    state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(n):
        state = _table()[state & np.uint32(255)] ^ (state >> np.uint32(8))
    return state.reshape(4, 256)


def crc32c(data: bytes) -> int:
    table, state = _table(), 0xFFFFFFFF
    lanes = len(data) // _LANE
    if lanes > 1:
        piece = np.frombuffer(data, np.uint8, lanes * _LANE).reshape(lanes, _LANE)
        own = np.zeros(lanes, np.uint32)
        for j in range(_LANE):
            own = table[(own ^ piece[:, j]) & np.uint32(255)] ^ (own >> np.uint32(8))
        shift = [row.tolist() for row in _shift(_LANE)]
        for value in own.tolist():
            state = shift[0][state & 255] ^ shift[1][state >> 8 & 255] ^ shift[2][state >> 16 & 255] ^ shift[3][state >> 24] ^ value
        data = data[lanes * _LANE :]
    plain = table.tolist() if len(data) > 64 else table
    for byte in data:
        state = int(plain[(state ^ byte) & 255]) ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """A checksum as shards store it."""
    return ((crc >> 15 | crc << 17) + RAISED) & 0xFFFFFFFF
