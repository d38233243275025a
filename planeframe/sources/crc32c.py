"""CRC-32C (Castagnoli), which Spark's crc32 is not. The table comes from the reflected polynomial."""

from __future__ import annotations

POLYNOMIAL = 0x82F63B78


def _entry(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
    return n


_TABLE = [_entry(n) for n in range(256)]


def crc32c(raw: bytes, value: int = 0) -> int:
    value ^= 0xFFFFFFFF
    for b in raw:
        value = _TABLE[(value ^ b) & 0xFF] ^ value >> 8
    return value ^ 0xFFFFFFFF
