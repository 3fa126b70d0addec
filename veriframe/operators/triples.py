"""What Python workers do for window triples: relations of three windows found and verified in bounded steps, and the largest kept.

Windows are float arrays of one row a place and one column a window. Sums run from the first place to the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa

LEAST_GAP, WIDEST, APART = 6e-6, 2.5, 8.0  # of projections, which lie between -1 and 1
PAIRS, MET, HELD = 1 << 14, 1 << 17, 1 << 19  # pairs of windows, meetings, and values (or those of one row), that are held at once
TEN = Context(prec=10, rounding=ROUND_HALF_UP)


def over(x, y):
    return x / np.where(np.abs(y) > 1e-9, y, np.nan)


DIRECT = {"A + B": lambda a, b: a + b, "A - B": lambda a, b: a - b, "B - A": lambda a, b: b - a, "A * B": lambda a, b: a * b, "A / B": over, "B / A": lambda a, b: over(b, a)}
SCALED = {"A / (A + B)": lambda a, b: over(a, a + b), "B / (A + B)": lambda a, b: over(b, a + b)}
NAMED = DIRECT | SCALED
WEIGHTED = (("A", "B"), ("B", "A"))
RELATIONS = {k: f"target = {x}" for k, x in enumerate(DIRECT)} | {k + 10: f"target = constant * {f'({x})' if k < 3 else x}" for k, x in enumerate(NAMED)} | {k + 20: f"target = {x} + constant * {y}" for k, (x, y) in enumerate(WEIGHTED)}


def most(v: np.ndarray) -> np.ndarray:
    return reduce(np.maximum, v)


def differs(v: np.ndarray) -> np.ndarray:
    """Finite and not constant in ten significant digits."""
    lo, hi = reduce(np.minimum, v), most(v)
    largest = np.maximum(np.abs(lo), np.abs(hi))
    out = np.isfinite(lo) & np.isfinite(hi) & (hi > lo)
    for k in np.flatnonzero(out & (hi - lo <= 2e-9 * largest)):
        out[k] = TEN.create_decimal(repr(float(lo[k]))) != TEN.create_decimal(repr(float(hi[k])))
    return out


def close(seen: np.ndarray, want: np.ndarray, rel: float) -> np.ndarray:
    """All within 1e-9, or all within rel of the larger side."""
    error = np.abs(seen - want)
    share = error / np.maximum(np.maximum(np.abs(seen), np.abs(want)), 1e-9)
    return (most(error) <= 1e-9) | (most(share) <= rel)


def scale(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Least-squares ratio of t to s over at least three values other than 0; NaN if there is none."""
    both = np.abs(s) > 1e-9
    square = sum(np.where(both, s * s, 0.0))
    ratio = sum(np.where(both, s * t, 0.0)) / np.where(square > 1e-9, square, np.nan)
    return np.where((both.sum(0) >= 3) & (np.abs(ratio) > 1e-9), ratio, np.nan)


def first(a: np.ndarray, b: np.ndarray, t: np.ndarray, rel: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and constant of the first relation that holds, -1 and NaN if none does."""
    rank, constant = np.full(t.shape[1], -1), np.full(t.shape[1], np.nan)

    def take(holds, k, c):
        new = holds & (rank < 0)
        rank[new], constant[new] = k, np.broadcast_to(c, new.shape)[new]

    bases = [(v := f(a, b), differs(v)) for f in NAMED.values()]
    for k, (v, good) in enumerate(bases[: len(DIRECT)]):
        take(good & close(t, v, rel), k, 1.0)
    for k, (v, good) in enumerate(bases):
        c = scale(v, t)
        take(good & (np.abs(c - 1) > rel) & close(t, v * c, rel), k + 10, c)
    for k, (own, other) in enumerate(((a, b), (b, a))):
        rest = t - own
        c = scale(other, rest)
        take(differs(rest) & (np.abs(np.abs(c) - 1) > rel) & close(t, own + other * c, rel), k + 20, c)
    return rank, constant


def norm(v: np.ndarray) -> np.ndarray:
    largest = most(np.abs(v))
    return largest * np.sqrt(sum((v / largest) ** 2))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / most(np.abs(v))
    return v / np.sqrt(sum(v * v))


def projection(u: np.ndarray) -> np.ndarray:
    """Directions that are d apart differ by at most d here."""
    return sum(x * np.cos((i + 1) * 0.7) for i, x in enumerate(u)) / np.sqrt(len(u))


def gap(v: np.ndarray, basis: np.ndarray, rel: float) -> np.ndarray:
    """How far the direction of basis may lie from its source's when v is off by rel of itself or by 1e-9."""
    return np.clip(2.1 * (rel * norm(v) + 1e-9 * np.sqrt(len(v))) / norm(basis), LEAST_GAP, WIDEST)


class Windows:
    """The windows of n values of a batch's blocks that are not constant: row, pos, v; those of row r are first[r] to first[r + 1],
    of them those of its part, share positions long, begin[r] to end[r]."""

    def __init__(self, vals: pa.ListArray, n: int, part: np.ndarray, share: int):
        offsets = vals.offsets.to_numpy().astype(np.int64)
        flat = vals.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(float)
        start, size = offsets[:-1] - offsets[0], np.diff(offsets)
        count = np.where(vals.is_valid().to_numpy(zero_copy_only=False), np.maximum(size - n + 1, 0), 0)
        row = np.repeat(np.arange(len(vals)), count)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        v = flat[start[row] + pos + np.arange(n)[:, None]] if len(row) else np.empty((n, 0))
        good = differs(v) if len(row) else np.empty(0, bool)
        self.row, self.pos, self.v = row[good], pos[good], v[:, good]
        self.first = np.searchsorted(self.row, np.arange(len(vals) + 1))
        wide = int(size.max(initial=0)) + 1
        bound = lambda p: np.searchsorted(self.row * wide + self.pos, np.arange(len(vals)) * wide + np.minimum(p * share, wide - 1))
        self.begin, self.end = bound(part), bound(part + 1)


def meetings(u: np.ndarray, row: np.ndarray, v: np.ndarray, at: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of u and v of the same row whose directions, of either sign, are within reach[column of v], all of one column of v together."""
    row0 = min(row[0], at[0]) if len(row) and len(at) else 0
    key = (row - row0) * APART + projection(u)
    order = np.argsort(key)  # what has no direction comes last
    key = key[order][: np.isfinite(key).sum()]
    p = projection(v)
    known = np.flatnonzero(np.isfinite(p))
    ends = lambda e, side: np.searchsorted(key, (at[known] - row0)[:, None] * APART + p[known, None] * [1, -1] + e * reach[known, None], side)
    lo, hi = ends(-1, "left"), ends(1, "right")
    upto = np.concatenate([[0], np.cumsum((hi - lo).sum(1))])
    s = 0
    while s < len(known):
        e = max(s + 1, int(np.searchsorted(upto, upto[s] + MET, "right")) - 1)
        count = (hi - lo)[s:e].ravel()
        if total := count.sum():
            x = order[np.arange(total) + np.repeat(lo[s:e].ravel() - (np.cumsum(count) - count), count)]
            y = np.repeat(np.repeat(known[s:e], 2), count)
            near = np.minimum(most(np.abs(u[:, x] - v[:, y])), most(np.abs(u[:, x] + v[:, y]))) <= reach[y]
            if near.any():
                yield x[near], y[near]
        s = e


def pairs(x: Windows, y: Windows, third: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, and the columns of x and y, of all pairs of a window of x's part and one of y, of rows that have all three; so many at once as are held."""
    nx, ny = x.end - x.begin, np.diff(y.first)
    count = np.where(np.diff(third.first) > 0, nx * ny, 0)
    upto = np.cumsum(count)
    for s in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        k = np.arange(s, min(s + PAIRS, upto[-1]))
        r = np.searchsorted(upto, k, "right")
        i, j = np.divmod(k - (upto - count)[r], ny[r])
        yield r, x.begin[r] + i, y.first[r] + j


def triples(a: Windows, b: Windows, t: Windows, rel: float) -> Iterator[tuple]:
    """Columns of a, b and t, rank and constant of each three windows with a relation, once; in one of the parts of the rows' blocks."""

    def found(i, j, k, low, high):
        rank, constant = first(a.v[:, i], b.v[:, j], t.v[:, k], rel)
        own = (low <= rank) & (rank <= high)
        return i[own], j[own], k[own], rank[own], constant[own]

    once = lambda pair, third: np.divmod(np.unique(pair * (third.max() + 1) + third), third.max() + 1)
    ut, reach = unit(t.v), gap(t.v, t.v, rel)
    for r, i, j in pairs(a, b, t):
        u = np.concatenate([unit(f(a.v[:, i], b.v[:, j])) for f in NAMED.values()], axis=1)
        of = slice(t.first[r[0]], t.first[r[-1] + 1])
        for x, y in meetings(u, np.tile(r, len(NAMED)), ut[:, of], t.row[of], reach[of]):
            x, y = once(x % len(r), y)
            yield found(i[x], j[x], y + of.start, 0, 19)
    # weighted: target - one source is a multiple of the other
    for n, (own, other) in enumerate(((a, b), (b, a))):
        uo = unit(other.v)
        for r, i, k in pairs(own, t, other):
            rest = t.v[:, k] - own.v[:, i]
            of = slice(other.first[r[0]], other.first[r[-1] + 1])
            for x, y in meetings(uo[:, of], other.row[of], unit(rest), r, gap(t.v[:, k], rest, rel)):
                y, x = once(y, x)
                yield found(*((i[y], x + of.start) if own is a else (x + of.start, i[y])), k[y], 20 + n, 20 + n)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    upto = np.cumsum(sum(np.diff(batch.column(f"vals_{x}").offsets.to_numpy()).astype(np.int64) for x in "xyz"))
    s = 0
    while s < len(batch):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + HELD, "right")))
        yield batch.slice(s, e - s)
        s = e


def search(batches: Iterator[pa.RecordBatch], shortest: int, longest: int, rel: float, share: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """key_x, key_y, key_z and vals_x, vals_y, vals_z of blocks that follow each other, each once as the target: a, b, t, pa, pb, pt, length, rank, constant.

    A row's part, if it has one, says which share of the work it is; the shares of all parts are the whole.
    """
    with np.errstate(all="ignore"):
        for batch in (x for whole in batches for x in slices(whole)):
            part = batch.column("part").to_numpy().astype(np.int64) if "part" in batch.schema.names else np.zeros(len(batch), np.int64)
            for n in range(shortest, longest + 1):
                w = {x: Windows(batch.column(f"vals_{x}"), n, part, share) for x in "xyz"}
                for a, b, t in ("xyz", "yzx", "xzy"):
                    for i, j, k, rank, constant in triples(w[a], w[b], w[t], rel):
                        if len(i):
                            keys = [batch.column(f"key_{x}").take(pa.array(w[a].row[i])) for x in (a, b, t)]
                            ints = [pa.array(x, pa.int32()) for x in (w[a].pos[i], w[b].pos[j], w[t].pos[k], np.full(len(i), n), rank)]
                            yield pa.RecordBatch.from_arrays([*keys, *ints, pa.array(constant)], ["a", "b", "t", "pa", "pb", "pt", "length", "rank", "constant"])


def maximal(group: np.ndarray, length: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
    """Which rows' windows do not all lie in those of a longer row of their group; of equal rows the first. Groups lie together, numbered from 0."""
    longest = np.maximum.reduceat(length, np.searchsorted(group, np.arange(group[-1] + 1)))[group]
    base, code, names = [int(x.max()) + 1 for x in (*starts, length)], group.astype(np.int64), []
    for k, x in enumerate((*starts, length)):  # codes are numbered anew at each column, so they stay small
        known, at, code = np.unique(code * base[k] + x, return_index=True, return_inverse=True)
        names.append(known)
    keep = np.zeros(len(group), bool)
    keep[at] = True
    for more in range(1, int((longest - length).max()) + 1):
        for back in product(range(more + 1), repeat=len(starts)):
            left = np.flatnonzero(keep & (length + more <= longest))
            code = group[left].astype(np.int64)
            for k, (column, by) in enumerate(zip((*starts, length), (*back, -more), strict=True)):
                x = column[left] - by
                want = code * base[k] + x
                code = np.minimum(np.searchsorted(names[k], want), len(names[k]) - 1)
                held = (names[k][code] == want) & (x >= 0)
                left, code = left[held], code[held]
            keep[left] = False
    return keep


def keep_largest(batches: Iterator[pa.RecordBatch], starts: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, of which __first marks the beginnings, without those that lie in a longer one of their group; a group is held whole.

    Where a row's __own is false, it is there for others only.
    """
    held: list[pa.RecordBatch] = []

    def kept(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, rows)):
            x = pa.Table.from_batches(rows)
            col = lambda c: x.column(c).to_numpy()
            keep = maximal(np.cumsum(col("__first")) - 1, col("length").astype(np.int64), [col(c).astype(np.int64) for c in starts])
            if "__own" in x.column_names:
                keep &= col("__own")
            yield from x.select([c for c in x.column_names if c not in ("__first", "__own")]).filter(pa.array(keep)).combine_chunks().to_batches()

    for batch in batches:
        begins = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
        if len(begins):
            yield from kept([*held, batch.slice(0, begins[-1])])
            held = []
        held.append(batch.slice(begins[-1] if len(begins) else 0))
    yield from kept(held)
