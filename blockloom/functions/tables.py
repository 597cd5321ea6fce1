"""Fixed values of the codec: quantisation matrix, scan tables, fixed-point magnitudes."""

from __future__ import annotations

import math

#: The luminance quantisation matrix, row by row.
QUANT = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]


def zigzag() -> list[int]:
    """The place of each coefficient in zigzag order: along the anti-diagonals, up on even ones and down on odd ones."""
    return sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


def rank() -> list[int]:
    """The inverse of the zigzag order: where each place stands in it. One format uses it as its scan."""
    z = zigzag()
    return [z.index(p) for p in range(64)]


def basis() -> list[float]:
    """The orthonormal cosine basis, frequency by frequency."""
    return [(math.sqrt(1 / 8) if f == 0 else math.sqrt(1 / 4)) * math.cos((2 * p + 1) * f * math.pi / 16) for f in range(8) for p in range(8)]


def fixed_basis(bits: int = 16) -> list[int]:
    """The basis as integers with so many fraction bits, rounded to the nearest."""
    return [int(math.floor(c * 2**bits + 0.5)) for c in basis()]
