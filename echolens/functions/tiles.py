"""Column expressions on 8x8 gray tiles held as arrays of 64 numbers, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8
#: Right-angle turns and flips as index permutations: out[k] = tile[perm[k]].
TURNS = {
    "id": lambda r, c: (r, c),
    "rot90": lambda r, c: (c, SIDE - 1 - r),
    "rot180": lambda r, c: (SIDE - 1 - r, SIDE - 1 - c),
    "rot270": lambda r, c: (SIDE - 1 - c, r),
    "flipH": lambda r, c: (r, SIDE - 1 - c),
    "flipV": lambda r, c: (SIDE - 1 - r, c),
}


def permutation(turn: str) -> list[int]:
    f = TURNS[turn]
    return [a * SIDE + b for a, b in (f(r, c) for r in range(SIDE) for c in range(SIDE))]


def turned(tile: Column, turn: str) -> Column:
    return F.array(*[tile[i] for i in permutation(turn)])


def let(value: Column, body) -> Column:
    """body of a value that is computed once a row: Catalyst would copy a plain column into each use."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def compare_bits(tile: Column, places: list[tuple[int, int]]) -> Column:
    """One bit for each (a, b), the first in the lowest place: is cell b brighter than cell a? A loop
    over constants, so that generated code stays small."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in reversed(places)])
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, p: s * 2 + (tile[p["b"]] > tile[p["a"]]).cast("bigint"))


def dhash(tile: Column, perm: list[int] | None = None) -> Column:
    """56 bits: is a cell brighter than the one to its left?"""
    p = perm or list(range(64))
    return compare_bits(tile, [(p[r * 8 + c], p[r * 8 + c + 1]) for r in range(8) for c in range(7)])


def lower_bits(tile: Column, perm: list[int] | None = None) -> Column:
    """56 bits: is a cell brighter than the one above it?"""
    p = perm or list(range(64))
    return compare_bits(tile, [(p[r * 8 + c], p[r * 8 + 8 + c]) for r in range(7) for c in range(8)])


def grid_hash(tile: Column, perm: list[int] | None = None) -> Column:
    """112 bits in two words: the comparisons along rows and along columns."""
    return F.array(dhash(tile, perm), lower_bits(tile, perm))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes held as array<bigint>."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def copy_of(tile: Column, key: Column) -> Column:
    """A tile's copy by rule: brighter, noisy, darker, turned, mirrored or very noisy by its key."""
    noise = lambda size: F.transform(tile, lambda x, i: x + ((key * 31 + (i + 1) * 17) % 101 - 50) * F.lit(size))
    kinds = [F.transform(tile, lambda x: x * 1.25 + 0.02), noise(0.0002), F.transform(tile, lambda x: x * 0.8 - 0.01), turned(tile, "rot90"), turned(tile, "flipH"), noise(0.0008)]
    out = kinds[5]
    for k in range(4, -1, -1):
        out = F.when(key % 6 == k, kinds[k]).otherwise(out)
    return out


def words(tile: Column) -> Column:
    """The distinct visual words of a tile: of each inner cell and its right neighbour, which of the
    eight cells around are brighter, as 16 bits."""
    around = F.array(*[F.lit(d) for d in (9, 8, 7, 1, -1, -7, -8, -9)])

    def code(at: Column) -> Column:
        return F.aggregate(around, F.lit(0), lambda s, d: s * 2 + (tile[at + d] > tile[at]).cast("int"))

    places = F.array(*[F.lit(r * 8 + c) for r in range(1, 7) for c in range(1, 6)])
    return F.array_distinct(F.transform(places, lambda at: code(at) * 256 + code(at + 1)))


def window(tile: Column, row: Column, col: Column, side: int) -> Column:
    """The side x side cells from (row, col) on, row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: tile[((row + F.floor(k / side)) * SIDE + col + k % side).cast("int")])


def weighted_ssim(a: Column, b: Column, side: int = 4, c1: float = 1e-4, c2: float = 9e-4) -> Column:
    """Mean structural similarity over all windows, weighted by their mean variance."""
    n = SIDE - side + 1

    def of(t: Column) -> Column:
        x, y = t["x"], t["y"]
        va, vb = variance(x), variance(y)
        return F.struct(ssim(mean(x), mean(y), va, vb, covariance(x, y), c1, c2).alias("s"), ((va + vb) / 2).alias("w"))

    def windows(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda o: F.struct(window(t["a"], F.floor(o / n), o % n, side).alias("x"), window(t["b"], F.floor(o / n), o % n, side).alias("y")))

    def merged(parts: Column) -> Column:
        total = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, p: s + f(p))
        weight = total(lambda p: p["w"])
        return F.when(weight < 1e-6, total(lambda p: p["s"]) / (n * n)).otherwise(total(lambda p: p["s"] * p["w"]) / weight)

    return let(F.struct(a.alias("a"), b.alias("b")), lambda t: let(F.transform(windows(t), of), merged))


def standardised(tile: Column) -> Column:
    """The tile with mean 0 and variance 1; an even tile only loses its mean."""
    ms = F.struct(mean(tile).alias("m"), F.sqrt(variance(tile)).alias("s"))
    return let(ms, lambda t: F.transform(tile, lambda x: F.when(t["s"] > 1e-6, (x - t["m"]) / t["s"]).otherwise(x - t["m"])))


def textured(tile: Column, least: float = 0.01) -> Column:
    """For each inner cell, row by row: is the variance of the 3 x 3 cells around it above the limit?"""
    return F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: variance(window(tile, F.floor(k / 6), k % 6, 3)) > least)


def dct_coefficients(tile: Column, low: int = 4) -> Column:
    """The low x low lowest DCT-II coefficients, row by row, rounded."""
    t = [[math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(low)]
    weights = F.array(*[F.array(*[F.lit(t[u][r] * t[v][c]) for r in range(8) for c in range(8)]) for u in range(low) for v in range(low)])
    return F.transform(weights, lambda w: F.round(dot(tile, w), 6))


def phash(coefficients: Column, low: int = 4) -> Column:
    """Bits, the first in the lowest place: is a coefficient above the median of all but the constant one?"""
    def bits(c: Column) -> Column:
        rest = F.sort_array(F.slice(c, 2, low * low - 1))
        return let(rest[(low * low - 2) // 2], lambda m: F.aggregate(F.reverse(c), F.lit(0).cast("bigint"), lambda s, x: s * 2 + (x > m).cast("bigint")))

    return let(coefficients, bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mean(tile: Column) -> Column:
    return F.aggregate(tile, F.lit(0.0), lambda a, x: a + x) / F.size(tile)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def variance(tile: Column) -> Column:
    m = mean(tile)
    return F.greatest(dot(tile, tile) / F.size(tile) - m * m, F.lit(0.0))


def covariance(a: Column, b: Column) -> Column:
    return dot(a, b) / F.size(a) - mean(a) * mean(b)


def histogram(tile: Column, bins: int = 16, low: float = -0.5, high: float = 0.5) -> Column:
    """Share of cells in each of equal bins; values beyond the ends count in the end bins."""
    at = F.transform(tile, lambda x: F.least(F.greatest(F.floor((x.cast("double") - low) / ((high - low) / bins)), F.lit(0).cast("bigint")), F.lit(bins - 1).cast("bigint")))
    return F.array(*[F.size(F.filter(at, lambda x: x == k)) / F.size(tile) for k in range(bins)])


def js_similarity(p: Column, q: Column) -> Column:
    """1 - Jensen-Shannon divergence over ln 2, at least 0."""
    def kl(x, m):
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda x, y: 0.5 * (kl(x, (x + y) / 2) + kl(y, (x + y) / 2)))
    js = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - js / math.log(2))


def ssim(ma: Column, mb: Column, va: Column, vb: Column, cov: Column, c1: float = 1e-4, c2: float = 9e-4) -> Column:
    """Structural similarity from moments."""
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of boxes (x, y, w, h); 0 if the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
