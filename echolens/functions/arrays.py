"""Tiles in numpy, many at once: what ``tiles`` computes, with the same operations in the same order, so that
a sum over cells has the same last bit. Column expressions with loops are interpreted by Spark cell by cell;
a pair's checks take some thousand such steps.

A tile is a row of 64 numbers. Comparisons hold NaN for the largest number, as Spark does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from . import tiles as T


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, ok): an Arrow list column as rows of 64; rows that are not 64 numbers are zeros and not ok."""
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
    ok, flat = size == 64, column.flatten()
    if flat.null_count:
        none = np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)]
        ok[none] = False
    out = np.zeros((len(size), 64))
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out[ok] = flat.to_numpy(zero_copy_only=False).astype(float)[start[ok, None] + np.arange(64)] if ok.any() else 0
    return out, ok


def above(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def bits(e: np.ndarray, places: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(e), np.int64)
    for k, (a, b) in enumerate(places):
        out |= above(e[:, b], e[:, a]).astype(np.int64) << k
    return out


ALONG = [(r * 8 + c, r * 8 + c + 1) for r in range(8) for c in range(7)]
DOWN = [(r * 8 + c, r * 8 + 8 + c) for r in range(7) for c in range(8)]


def total(x: np.ndarray) -> np.ndarray:
    """The sum of each row, from its first cell on."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s = s + x[:, k]
    return s


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = np.zeros(len(a))
    for k in range(a.shape[1]):
        s = s + a[:, k] * b[:, k]
    return s


def mean(x: np.ndarray) -> np.ndarray:
    return total(x) / x.shape[1]


def variance(x: np.ndarray) -> np.ndarray:
    m = mean(x)
    return np.maximum(dot(x, x) / x.shape[1] - m * m, 0.0)


def phash(e: np.ndarray, low: int = 4) -> np.ndarray:
    t = [[math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(low)]
    c = []
    for u in range(low):
        for v in range(low):
            s = np.zeros(len(e))
            for r in range(8):
                for k in range(8):
                    s = s + e[:, r * 8 + k] * (t[u][r] * t[v][k])
            c.append(np.round(s, 6))
    median = np.sort(np.stack(c[1:], 1), axis=1)[:, (low * low - 2) // 2]
    out = np.zeros(len(e), np.int64)
    for k, x in enumerate(c):
        out |= above(x, median).astype(np.int64) << k
    return out


def hashes(batches):
    """id, e with the 112 bits of ``grid_hash`` (h, two words) and the 16 of ``phash`` (p); null for what is no tile."""
    for b in batches:
        e, ok = cells(b.column("e"))
        h = np.stack([bits(e, ALONG), bits(e, DOWN)], 1)
        at = np.concatenate([[0], np.cumsum(np.where(ok, 2, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(~ok, False)) if not ok.all() else pa.array(at, pa.int32()), pa.array(h[ok].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), lists, pa.array(phash(e), pa.int64(), mask=~ok)], ["id", "e", "h", "p"])


_AROUND = (-9, -8, -7, -1, 1, 7, 8, 9)


def words(batches):
    """id and the distinct visual words of ``tiles.words`` (keys); what is no tile has none."""
    for b in batches:
        e, ok = cells(b.column("e"))
        code = {}
        for at in {r * 8 + c for r in range(1, 7) for c in range(1, 7)}:
            code[at] = bits(e, [(at, at + d) for d in _AROUND])
        w = np.sort(np.stack([code[r * 8 + c] * 256 + code[r * 8 + c + 1] for r in range(1, 7) for c in range(1, 6)], 1), axis=1)
        new = np.concatenate([np.ones((len(w), 1), bool), w[:, 1:] != w[:, :-1]], 1) & ok[:, None]
        at = np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(w[new], pa.int64()))], ["id", "keys"])


def prefixes(turns: tuple[str, ...], n: int = 12):
    """id and the lowest ``n`` bits of ``tiles.dhash`` of each of a tile's turns (keys)."""
    places = [[(p[a], p[b]) for a, b in ALONG[:n]] for p in map(T.permutation, turns)]

    def run(batches):
        for b in batches:
            e, ok = cells(b.column("e"))
            k = np.stack([bits(e, p) for p in places], 1)
            at = np.concatenate([[0], np.cumsum(np.where(ok, len(places), 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(k[ok].ravel(), pa.int64()))], ["id", "keys"])

    return run


def signs(planes: list[list[int]], per_table: int):
    """id and, for each table of ``per_table`` planes, the signs of a tile's whole-number projections as one number (keys)."""

    def run(batches):
        p, tables = np.array(planes, float).T, len(planes) // per_table
        for b in batches:
            e, ok = cells(b.column("e"))
            r = np.trunc(x := e * 1000000)
            r += np.where(np.abs(x - r) >= 0.5, np.sign(x), 0)
            on = above(r @ p, np.zeros((len(e), len(planes))))  # whole numbers: exact in any order
            k = (on.reshape(len(e), tables, per_table) << np.arange(per_table)).sum(2) + np.arange(tables) * 65536
            at = np.concatenate([[0], np.cumsum(np.where(ok, tables, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(k[ok].ravel(), pa.int64()))], ["id", "keys"])

    return run


# ---- checks of pairs: tiles a and b, row by row ---------------------------------------------------
def _window(e: np.ndarray, row: int, col: int, side: int) -> np.ndarray:
    return e[:, [(row + k // side) * T.SIDE + col + k % side for k in range(side * side)]]


def moments(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    ma, mb = mean(a), mean(b)
    return {"ma": ma, "mb": mb, "va": variance(a), "vb": variance(b), "cov": dot(a, b) / a.shape[1] - ma * mb}


def histogram(e: np.ndarray, bins: int = 16, low: float = -0.5, high: float = 0.5) -> list:
    at = np.clip(np.nan_to_num(np.floor((e - low) / ((high - low) / bins)), nan=0.0), 0, bins - 1)
    return list(np.stack([(at == k).sum(1) for k in range(bins)], 1) / e.shape[1])


def histograms(a: np.ndarray, b: np.ndarray) -> dict[str, list]:
    return {"p": histogram(a), "q": histogram(b)}


def textured(e: np.ndarray, least: float = 0.01) -> np.ndarray:
    return np.stack([~(variance(_window(e, k // 6, k % 6, 3)) <= least) for k in range(36)], 1)


def masked_ncc(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """n and ncc over the inner cells that both have texture in. A cell that is left out adds zero to a sum."""
    both = textured(a) & textured(b)
    n, at = both.sum(1), [(k // 6 + 1) * 8 + k % 6 + 1 for k in range(36)]
    u, v = np.where(both, a[:, at], 0.0), np.where(both, b[:, at], 0.0)
    with np.errstate(all="ignore"):
        su, sv = total(u), total(v)
        ncc = (dot(u, v) - su * sv / n) / np.sqrt((dot(u, u) - su * su / n) * (dot(v, v) - sv * sv / n))
    return {"n": n.astype(np.int32), "ncc": ncc}


def template_ncc(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """s: the correlation of a's middle 4 x 4 with each of the 25 windows of b."""
    t = _window(a, 2, 2, 4)
    out, st, tt = [], total(t), dot(t, t)
    with np.errstate(all="ignore"):
        for o in range(25):
            w = _window(b, o // 5, o % 5, 4)
            sw = total(w)
            out.append((dot(t, w) - st * sw / 16) / np.sqrt((tt - st * st / 16) * (dot(w, w) - sw * sw / 16)))
    return {"s": list(np.stack(out, 1)) if len(a) else []}


def standardised(e: np.ndarray) -> np.ndarray:
    m, s = mean(e)[:, None], np.sqrt(variance(e))[:, None]
    with np.errstate(all="ignore"):
        return np.where(~(s <= 1e-6), (e - m) / s, e - m)


def weighted_ssim(a: np.ndarray, b: np.ndarray, side: int = 4, c1: float = 1e-4, c2: float = 9e-4) -> dict[str, np.ndarray]:
    n = T.SIDE - side + 1
    plain, weighted, weight = (np.zeros(len(a)) for _ in range(3))
    with np.errstate(all="ignore"):
        for o in range(n * n):
            x, y = _window(a, o // n, o % n, side), _window(b, o // n, o % n, side)
            ma, mb, va, vb = mean(x), mean(y), variance(x), variance(y)
            cov = dot(x, y) / x.shape[1] - ma * mb
            s, w = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), (va + vb) / 2
            plain, weighted, weight = plain + s, weighted + s * w, weight + w
        return {"ssim": np.where(weight < 1e-6, plain / (n * n), weighted / weight)}


def weighted_ssim_z(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    return weighted_ssim(standardised(a), standardised(b))
