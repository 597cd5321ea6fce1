"""The codec over whole batches of blocks in numpy. Sums run in ascending order, one term of all blocks at a time, so no
product of matrices is left to a library's own order. Blocks are rows of 64, row-major or in scan order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions import tables

_Q = np.array(tables.QUANT).reshape(8, 8)
#: Bytes of bits that a block has room for, and pairs.
ROOM, SLOTS = 192, 63
PAIR = pa.struct([("zero_run", pa.int32()), ("value", pa.int32())])


def away(y: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    size = np.abs(y)
    whole = np.floor(size)
    return np.copysign(whole + (size - whole >= 0.5), y)


def _even(v: np.ndarray, bits: int) -> np.ndarray:
    low, rest, half = v >> bits, v & ((1 << bits) - 1), 1 << (bits - 1)
    return low + ((rest > half) | ((rest == half) & (low & 1 == 1)))


def _rows(c: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    return c[None, :, k, None] * x[:, None, k, :]


def _columns(c: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    return t[:, :, k, None] * c[None, None, :, k]


def _ordered(side, c: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = side(c, x, 0)
    for k in range(1, 8):
        out = out + side(c, x, k)
    return out


def _shift_away(v: np.ndarray, bits: int) -> np.ndarray:
    return np.sign(v) * ((np.abs(v) + (1 << (bits - 1))) >> bits)


def pixels(vectors: np.ndarray) -> np.ndarray:
    """Pixels of vectors: 128 and 256 times a component, rounded and clamped."""
    return np.clip(away(np.clip(128 + 256 * vectors.astype(np.float64), -1, 256)), 0, 255).astype(np.int64)


def dct(px: np.ndarray, arithmetic: str = "cpu") -> np.ndarray:
    """(n, 64) pixels to coefficients: doubles, or whole numbers with 19 (``stream``) or 22 (``fourk``) fraction bits."""
    x = px.reshape(-1, 8, 8).astype(np.int64) - 128
    if arithmetic == "cpu":
        c = np.array(tables.basis()).reshape(8, 8)
        return _ordered(_columns, c, _ordered(_rows, c, x.astype(np.float64))).reshape(-1, 64)
    c = np.array(tables.fixed_basis(), dtype=np.int64).reshape(8, 8)
    if arithmetic == "stream":
        t = sum(_even(_rows(c, x, k), 2) for k in range(8))
        return _even(_ordered(_columns, c, t), 11).reshape(-1, 64)
    if arithmetic != "fourk":
        raise ValueError(f"unknown arithmetic: {arithmetic}")
    t = _ordered(_rows, c, x)
    s = np.zeros_like(t)
    for k in range(8):
        s = _even((s << 10) + _columns(c, t, k), 10)
    return s.reshape(-1, 64)


def quantise(y: np.ndarray, arithmetic: str = "cpu") -> np.ndarray:
    """Coefficients of dct() to whole steps."""
    q = _Q.reshape(64)
    if arithmetic == "cpu":
        out = away(y / q).astype(np.int64)
    elif arithmetic == "stream":
        out = _shift_away(y * np.floor((1 << 23) / q + 0.5).astype(np.int64), 42)
    else:
        out = _shift_away(y * 4 // q, 24)
    return np.clip(out, -32768, 32767)


def quantised(px: np.ndarray, arithmetic: str) -> np.ndarray:
    """(n, 64) pixels to (n, 64) quantised coefficients."""
    return quantise(dct(px, arithmetic), arithmetic)


def restored(q: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
    """Quantised coefficients back to pixels, by the steps of each block or those of the codec."""
    steps = _Q.reshape(1, 64) if steps is None else steps
    d = (q.astype(np.float64) * steps.astype(np.float64)).reshape(-1, 8, 8)
    c = np.ascontiguousarray(np.array(tables.basis()).reshape(8, 8).T)
    y = _ordered(_columns, c, _ordered(_rows, c, d))
    return np.clip(away(y + 128), 0, 255).astype(np.int64).reshape(-1, 64)


def errors(o: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of errors by block; the error is the reconstruction less the original."""
    d = r - o
    a = np.abs(d)
    return {
        "pixels": np.full(len(o), 64), "signed_error": d.sum(axis=1), "absolute_error": a.sum(axis=1), "squared_error": (d * d).sum(axis=1), "signal": (o * o).sum(axis=1),
        "max_absolute_error": a.max(axis=1, initial=0), "exact_pixels": (a == 0).sum(axis=1), "within_1": (a <= 1).sum(axis=1), "within_2": (a <= 2).sum(axis=1),
    }


def similarity(o: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Structural similarity of whole blocks."""
    o, r = o.astype(np.float64), r.astype(np.float64)
    mo, mr = o.mean(axis=1), r.mean(axis=1)
    vo, vr, c = (o * o).mean(axis=1) - mo * mo, (r * r).mean(axis=1) - mr * mr, (o * r).mean(axis=1) - mo * mr
    k1, k2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * mo * mr + k1) * (2 * c + k2) / ((mo * mo + mr * mr + k1) * (vo + vr + k2))


class Pairs:
    """Run-length pairs of many blocks: those of block i are at offsets[i] to offsets[i + 1]."""

    __slots__ = ("offsets", "run", "value")

    def __init__(self, offsets: np.ndarray, run: np.ndarray, value: np.ndarray):
        self.offsets, self.run, self.value = offsets, run.astype(np.int64), value.astype(np.int64)

    @classmethod
    def of_scan(cls, scanned: np.ndarray) -> Pairs:
        """Each block's nonzero values after the first, with the zeros before each."""
        row, at = np.nonzero(scanned[:, 1:])
        at = at + 1
        before = np.where(np.r_[True, row[1:] != row[:-1]][: len(row)], 0, np.r_[0, at[:-1]][: len(row)])
        return cls(np.r_[0, np.cumsum(np.bincount(row, minlength=len(scanned)))], at - before - 1, scanned[row, at])

    @classmethod
    def of_arrow(cls, column: pa.ListArray) -> Pairs:
        """A null counts as no pairs."""
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        return cls(np.r_[0, np.cumsum(counts)], flat.field("zero_run").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False))

    def arrow(self, fine: np.ndarray | None = None) -> pa.ListArray:
        """With nulls for blocks that aren't fine, which have no pairs here."""
        pairs = pa.StructArray.from_arrays([pa.array(self.run.astype(np.int32)), pa.array(self.value.astype(np.int32))], fields=list(PAIR))
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pairs, mask=None if fine is None else pa.array(~fine))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def block(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)

    @property
    def index(self) -> np.ndarray:
        return np.arange(len(self.run)) - np.repeat(self.offsets[:-1], self.count)

    @property
    def position(self) -> np.ndarray:
        """Where each value stands in its block's scan."""
        ends = np.cumsum(self.run + 1)
        first = np.r_[0, ends][self.offsets[:-1]]
        return ends - np.repeat(first, self.count)

    @property
    def fits(self) -> np.ndarray:
        """Whether a block's pairs stay inside it."""
        last = np.zeros(len(self.offsets) - 1, dtype=np.int64)
        np.maximum.at(last, self.block, self.position)
        low = np.zeros(len(last), dtype=bool)
        np.logical_or.at(low, self.block, self.run < 0)
        return (last <= 63) & ~low & (self.count <= SLOTS)

    def scan(self, dc: np.ndarray) -> np.ndarray:
        """(n, 64) values in scan order; pairs that leave their block are left out."""
        out = np.zeros((len(dc), 64), dtype=np.int64)
        out[:, 0] = dc
        at, inside = self.position, np.repeat(self.fits, self.count)
        out[self.block[inside], at[inside]] = self.value[inside]
        return out

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each pair, their number, the value's category and amplitude, and whether it has any code: a byte for each
        16 zeros, run and category in a byte, the amplitude. Without entropy coding."""
        size = np.frexp(np.abs(self.value).astype(np.float64))[1].astype(np.int64)
        amplitude = np.where(self.value >= 0, self.value, self.value + (np.int64(1) << size) - 1)
        long_runs = np.minimum(self.run >> 4, 3)
        good = (size > 0) & (size <= 15)
        marks = np.int64(0xF0F0F0) >> (8 * (3 - long_runs))
        rest = ((((self.run - 16 * long_runs) & 15) << 4 | size) << size) | amplitude
        code = np.where(good, (marks << (8 + size)) | rest, marks)
        return code, 8 * long_runs + np.where(good, 8 + size, 0), size, amplitude, good

    def packed(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Number of bits, bytes (highest bit first, the last one filled with zeros) and status of each block. Status 1: a
        value without a code, 2: more bits than a block has room for, 4: pairs that leave the block. What was written
        before a fault stays; a block of status 4 has no bits."""
        code, length, _, _, good = self.codes()
        block, n, fits = self.block, len(self.offsets) - 1, self.fits
        faults = np.cumsum(~good)
        earlier = faults - ~good - np.repeat(np.r_[0, faults][self.offsets[:-1]], self.count)
        length = np.where((earlier > 0) | ~fits[block], 0, length)
        bad = np.zeros(n, dtype=bool)
        np.logical_or.at(bad, block, ~good)
        last = np.bincount(block, self.run + 1, n).astype(np.int64)
        total = np.bincount(block, length, n).astype(np.int64)
        total += np.where(fits & ~bad & (last < 63), 8, 0)
        over = total > 8 * ROOM
        bits = np.minimum(total, 8 * ROOM)
        starts = np.r_[0, np.cumsum((bits + 7) // 8)]
        ends = np.cumsum(length)
        within = ends - length - np.repeat(np.r_[0, ends][self.offsets[:-1]], self.count)
        each = np.repeat(np.arange(len(length)), length)
        k = np.arange(len(each)) - np.repeat(ends - length, length)
        place = within[each] + k
        room = place < 8 * ROOM
        out = np.zeros(8 * starts[-1], dtype=np.uint8)
        out[(8 * starts[block[each]] + place)[room]] = ((code[each] >> (length[each] - 1 - k)) & 1)[room]
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(np.packbits(out).tobytes())])
        return bits, data, np.where(fits, bad * 1 | over * 2, 4)

    @classmethod
    def unpacked(cls, bits: np.ndarray, data: list[bytes]) -> tuple[Pairs, np.ndarray]:
        """Pairs of packed blocks, all blocks a code at a time, and whether each was whole: bits that end inside a code, or
        codes that leave the block, give no pairs."""
        n = len(bits)
        wide = max([len(d) for d in data], default=0) + 5
        flat = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in data), dtype=np.uint8).reshape(n, wide).astype(np.uint64)
        have = np.minimum(bits, 8 * np.array([len(d) for d in data], dtype=np.int64))
        at, zeros, used = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        fine, live = have == bits, have > 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while live.any():
            i = np.flatnonzero(live)
            byte = at[i] >> 3
            window = np.zeros(len(i), dtype=np.uint64)
            for j in range(5):
                window = (window << np.uint64(8)) | flat[i, np.minimum(byte + j, wide - 1)]
            left = 40 - (at[i] & 7)  # bits of the window from here on
            symbol = ((window >> (left - 8).astype(np.uint64)) & np.uint64(255)).astype(np.int64)
            size, run = symbol & 15, symbol >> 4
            end, mark = symbol == 0, symbol == 0xF0
            length = 8 + np.where(mark, 0, size)
            raw = ((window >> (left - length).astype(np.uint64)) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            value = np.where(raw >> np.maximum(size - 1, 0) > 0, raw, raw - (np.int64(1) << size) + 1)
            here = zeros[i] + run
            real = ~end & ~mark
            zeros[i] = np.where(mark, zeros[i] + 16, 0)
            used[i] += np.where(real, here + 1, 0)
            at[i] += length
            broken = (at[i] > have[i]) | (real & (size == 0)) | (used[i] > 63) | (zeros[i] > 63)
            fine[i[broken]] = False
            found.append((i[real & ~broken], here[real & ~broken], value[real & ~broken]))
            live[i] = ~end & ~broken & (at[i] < have[i])
        row, run, value = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        order = np.argsort(row, kind="stable")
        order = order[fine[row[order]]]
        return cls(np.r_[0, np.cumsum(np.bincount(row[order], minlength=n))], run[order], value[order]), fine

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(n, 63) runs and values with zeros behind each block's pairs; blocks of more pairs than slots are refused."""
        if (self.count > SLOTS).any():
            raise ValueError("a block has over 63 pairs")
        run, value = (np.zeros((len(self.count), SLOTS), dtype=np.int64) for _ in range(2))
        run[self.block, self.index], value[self.block, self.index] = self.run, self.value
        return run, value

    @classmethod
    def of_slots(cls, count: np.ndarray, run: np.ndarray, value: np.ndarray) -> Pairs:
        """What fills the slots of each block; the rest is not looked at."""
        used = np.arange(SLOTS)[None, :] < count[:, None]
        return cls(np.r_[0, np.cumsum(count)], run[used], value[used])


def pairs_of(scanned: np.ndarray) -> pa.ListArray:
    """Each row's nonzero values after the first, with the zeros before each."""
    return Pairs.of_scan(scanned).arrow()
