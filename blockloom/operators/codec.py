"""Encoder and decoder steps on 8x8 blocks, as SQL expressions over arrays of 64.

Sums are written out in ascending order: with doubles their order is part of the result. Fixed-point variants use whole
numbers with so many fraction bits, so their sums are exact in any order.
"""

from __future__ import annotations

from ..functions import tables
from ..functions.dialect import Spark


def pixels(d: Spark, vector: str = "embedding") -> str:
    x = "greatest(least(round(128 + 256 * CAST(x AS DOUBLE)), 255), 0)"
    return d.map(vector, "x", f"CAST({x} AS {d.integer})")


def level_shift(d: Spark, px: str = "px") -> str:
    return d.map(px, "x", "x - 128")


def _product(d: Spark, c: str, x: str, first: bool, inverse: bool) -> list[tuple[str, str]]:
    """One side of the two-sided product, 8 terms for each element: rows of the basis against columns, or the other way."""
    terms = []
    for k in range(8):
        own, other = (f"(i {d.div} 8)", "(i % 8)")
        if first:
            basis_at = f"({k} * 8 + {own})" if inverse else f"({own} * 8 + {k})"
            at = f"({k} * 8 + {other})"
        else:
            basis_at = f"({k} * 8 + {other})" if inverse else f"({other} * 8 + {k})"
            at = f"({own} * 8 + {k})"
        terms.append((d.at(c, basis_at), d.at(x, at)))
    return terms


def dct(d: Spark, x: str = "shifted", inverse: bool = False) -> str:
    """C X C' (or C' X C), in doubles."""
    def side(v: str, first: bool) -> str:
        return d.map(d.range(64), "i", " + ".join(f"{a} * {b}" for a, b in _product(d, "c", v, first, inverse)))

    inner = d.let(side("x0", True), "t", side("t", False))
    return d.let(d.literal(tables.basis()), "c", d.let(x, "x0", inner))


def _half_even(d: Spark, v: str, bits: int) -> str:
    """v / 2**bits, ties to even."""
    floor = d.shift(v, bits)
    rest = f"(({v}) - ({floor}) * {1 << bits})"
    half = 1 << (bits - 1)
    return f"(({floor}) + CASE WHEN {rest} > {half} OR ({rest} = {half} AND ({floor}) % 2 <> 0) THEN 1 ELSE 0 END)"


def dct_stream(d: Spark, x: str = "shifted") -> str:
    """Fixed point: products rounded from 16 to 14 fraction bits, second stage exact at 30 and rounded to 19."""
    one = d.map(d.range(64), "i", " + ".join(_half_even(d, f"{a} * {b}", 2) for a, b in _product(d, "c", "x0", True, False)))
    two = d.map(d.range(64), "i", " + ".join(f"{a} * {b}" for a, b in _product(d, "c", "t", False, False)))
    rounded = d.let(two, "u", d.map("u", "y", _half_even(d, "y", 11)))
    return d.let(d.literal(tables.fixed_basis()), "c", d.let(d.map(x, "z", f"CAST(z AS {d.long})"), "x0", d.let(one, "t", rounded)))


def dct_fourk(d: Spark, x: str = "shifted") -> str:
    """Fixed point with ordered rounding: first stage exact at 16 fraction bits; in the second, the running sum has 22 and
    is rounded to even after each of its eight terms."""
    one = d.map(d.range(64), "i", " + ".join(f"{a} * {b}" for a, b in _product(d, "c", "x0", True, False)))
    terms = [f"{a} * {b}" for a, b in _product(d, "c", "t", False, False)]
    out = "a7"
    for k in range(7, -1, -1):
        running = f"{d.at(f'a{k - 1}', 'i')} * 1024 + " if k else ""
        out = d.let(d.map(d.range(64), "i", _half_even(d, f"({running}{terms[k]})", 10)), f"a{k}", out)
    return d.let(d.literal(tables.fixed_basis()), "c", d.let(d.map(x, "z", f"CAST(z AS {d.long})"), "x0", d.let(one, "t", out)))


def _clamp(x: str) -> str:
    return f"greatest(least({x}, 32767), -32768)"


def quantise(d: Spark, x: str = "dct") -> str:
    q = d.literal([float(v) for v in tables.QUANT])
    return d.let(q, "q", d.let(x, "y", d.map(d.range(64), "i", f"CAST({_clamp(f'round({d.at('y', 'i')} / {d.at('q', 'i')})')} AS {d.integer})")))


def quantise_stream(d: Spark, x: str = "dct") -> str:
    """By reciprocals of 23 fraction bits; the product has 42, halves go away from zero."""
    r = d.literal([int((1 << 23) / v + 0.5) for v in tables.QUANT])
    p = f"({d.at('y', 'i')} * {d.at('r', 'i')})"
    away = f"(CASE WHEN {p} < 0 THEN -1 ELSE 1 END * {d.shift(f'abs({p}) + {1 << 41}', 42)})"
    return d.let(r, "r", d.let(x, "y", d.map(d.range(64), "i", f"CAST({_clamp(away)} AS {d.integer})")))


def quantise_fourk(d: Spark, x: str = "fourk") -> str:
    """By division: from 22 fraction bits to a ratio of 24, rounded down; halves of the ratio go away from zero. The step
    is 10 at least, so no result leaves 16 bits."""
    ratio = d.map(d.range(64), "i", f"({d.at('y', 'i')} * 4 - (({d.at('y', 'i')} * 4) % {d.at('w', 'i')} + {d.at('w', 'i')}) % {d.at('w', 'i')}) {d.div} {d.at('w', 'i')}")
    rounded = d.map("r", "p", f"CAST(CASE WHEN p < 0 THEN -1 ELSE 1 END * {d.shift(f'abs(p) + {1 << 23}', 24)} AS {d.integer})")
    return d.let(d.literal(tables.QUANT), "w", d.let(x, "y", d.let(ratio, "r", rounded)))


def permute(d: Spark, table: list[int], x: str) -> str:
    return d.let(d.literal(table), "s", d.let(x, "y", d.map("s", "i", d.at("y", "i"))))


def dequantise(d: Spark, x: str = "q") -> str:
    return d.let(d.literal([float(v) for v in tables.QUANT]), "w", d.let(x, "y", d.map(d.range(64), "i", f"{d.at('y', 'i')} * {d.at('w', 'i')}")))


def restore(d: Spark, x: str = "idct") -> str:
    """Back to pixels: up by 128, rounded half away from zero, clamped."""
    return d.map(x, "y", f"CAST(greatest(least(round(y + 128), 255), 0) AS {d.integer})")
