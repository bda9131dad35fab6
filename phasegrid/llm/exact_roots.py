"""Largest eigenvalues and their eigenvectors of a symmetric integer matrix without rounding on the way.

The characteristic polynomial is found modulo primes by Hessenberg reduction (one
prime is one unit of work, dealt out by the caller) and put together by Chinese
remaindering.  All its roots are real and none is negative, so the number of roots
above a point is exactly the number of sign changes of the polynomial shifted there.
Vectors are null-space vectors by inverse iteration in fixed-point integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

GUARD = 96      # bits of a root beyond its own size, and of fixed-point arithmetic beyond the matrix


def is_prime(n: int) -> bool:
    """Deterministic below 3,215,031,751 (strong tests to bases 2, 3, 5 and 7)."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(limit: int = 1 << 31) -> Iterator[int]:
    for n in range(limit - 1, 2, -1):
        if is_prime(n):
            yield n


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient is larger: elementary symmetric sums of non-negative roots are largest when all are equal."""
    return max(math.comb(size, k) * trace**k // size**k + 1 for k in range(size + 1))


def enough_primes(bound: int) -> list[int]:
    """Primes whose product passes twice the bound, as coefficients have a sign."""
    out, product = [], 1
    for p in primes_below():
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise ValueError("not enough primes below 2^31")


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p`` below 2^31, highest power first."""
    h = np.array(matrix % p, np.int64)
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        m = k + 1 + int(below[0])
        if m != k + 1:      # the same swap of rows and columns keeps the polynomial
            h[[k + 1, m]] = h[[m, k + 1]]
            h[:, [k + 1, m]] = h[:, [m, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        # u has up to n terms below 2^31; products are reduced before they are summed
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    low = np.zeros((n + 1, n + 1), np.int64)    # row k: polynomial of the leading k by k block, lowest power first
    low[0, 0] = 1
    for k in range(1, n + 1):
        row = np.zeros(n + 1, np.int64)
        row[1:] = low[k - 1, :-1]
        weights = np.zeros(k, np.int64)
        run = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else run
        low[k] = (row - (weights[:, None] * low[:k] % p).sum(0)) % p
    return low[n, ::-1].copy()


def recombine(primes: list[int], residues: np.ndarray) -> list[int]:
    """Integers of least absolute value with the given residues, one a column."""
    product = math.prod(primes)
    total = [0] * residues.shape[1]
    for p, row in zip(primes, residues.tolist(), strict=True):
        rest = product // p
        unit = rest * pow(rest % p, -1, p)
        total = [t + r * unit for t, r in zip(total, row, strict=True)]
    return [t - product if t > product // 2 else t for t in (t % product for t in total)]


def roots_above(coefs: list[int], point: int) -> int:
    """Roots larger than ``point``, with multiplicity: sign changes after the shift (exact, as all roots are real)."""
    shifted = list(coefs)
    n = len(shifted) - 1
    for last in range(n, 0, -1):
        for i in range(1, last + 1):
            shifted[i] += point * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefs: list[int], count: int) -> list[tuple[int, int]]:
    """The ``count`` largest positive roots as (numerator, power of two under it), larger first, repeated by multiplicity.

    Each is isolated between neighbouring multiples of 2^-power, with GUARD bits more
    than the root's own size.
    """
    rank = len(coefs) - 1
    while rank and coefs[rank] == 0:        # zero roots are trailing zeros
        rank -= 1
    coefs = coefs[:rank + 1]
    top = max(-coefs[1], 1) if rank else 1      # the sum of all roots
    out: list[tuple[int, int]] = []
    for k in range(min(count, rank)):
        # power: enough that the root has GUARD bits; found on a coarse scale first
        power = 0
        scaled = coefs
        while roots_above(scaled, 1 << GUARD) <= k:
            power += GUARD
            scaled = [c << (power * i) for i, c in enumerate(coefs)]
        low, high = 1 << GUARD, (out[-1][0] << max(power - out[-1][1], 0)) if out else top << power
        low, high = min(low, high), high + 1
        while high - low > 1:       # the root is in (low, high]
            middle = (low + high) // 2
            low, high = (middle, high) if roots_above(scaled, middle) > k else (low, middle)
        out.append((high, power))
    return out


def eigenvector(matrix: list[list[int]], root: tuple[int, int], others: list[np.ndarray]) -> np.ndarray:
    """Unit vector of the null space of matrix - root, at right angles to ``others``; its largest entry is positive.

    Fixed-point elimination with partial pivots and inverse iteration; ``others`` are
    earlier vectors of the same root, in fixed point, as is the result.
    """
    n = len(matrix)
    bits = max(max(abs(v) for row in matrix for v in row).bit_length(), 1) + 2 * GUARD
    one = 1 << bits
    shift = root[0] << (bits - root[1]) if root[1] <= bits else root[0] >> (root[1] - bits)
    work = np.array([[v << bits for v in row] for row in matrix], object)
    work[np.arange(n), np.arange(n)] -= shift
    order = np.arange(n)
    for k in range(n):
        m = k + int(np.argmax(np.abs(work[k:, k])))
        if m != k:
            work[[k, m]] = work[[m, k]]
            order[[k, m]] = order[[m, k]]
        if not work[k, k]:
            work[k, k] = 1      # one unit of the last place
        if k + 1 < n:
            factor = (work[k + 1:, k] << bits) // work[k, k]
            work[k + 1:, k + 1:] -= (factor[:, None] * work[k, k + 1:]) >> bits
            work[k + 1:, k] = factor
    x = np.array([((2 * i * i + 3 * i + 7) % (2 * n + 5)) * one // (2 * n + 5) + 1 for i in range(n)], object)
    for _ in range(4):
        x = _unit(_square(x, others), bits)
        x = x[order]
        for i in range(1, n):
            x[i] -= (work[i, :i] * x[:i]).sum() >> bits
        for i in range(n - 1, -1, -1):
            rest = x[i] - ((work[i, i + 1:] * x[i + 1:]).sum() >> bits if i + 1 < n else 0)
            x[i] = (rest << bits) // work[i, i]
        x = _unit(x, bits)
    x = _unit(_square(x, others), bits)
    lead = int(np.argmax(np.abs(x)))
    return x if x[lead] > 0 else -x


def _unit(x: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int((x * x).sum()))
    return (x << bits) // max(length, 1)


def _square(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for v in others:
        scale = int((v * v).sum())
        x = x - v * int((x * v).sum()) // scale
    return x


def ratio(numerator: int, denominator: int) -> float:
    """Nearest double of a quotient of integers of any size."""
    return numerator / denominator


def top_components(matrix: list[list[int]], coefs: list[int], count: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Up to ``count`` largest roots and their unit vectors as rows of doubles."""
    roots = largest_roots(coefs, count)
    found: list[np.ndarray] = []
    rows = []
    for k, root in enumerate(roots):
        near = [found[i] for i in range(k) if _same(roots[i], root)]
        v = eigenvector(matrix, root, near)
        found.append(v)
        length = math.isqrt(int((v * v).sum()))
        rows.append([ratio(int(c), length) for c in v])
    return roots, np.array(rows, float).reshape(len(rows), len(matrix))


def _same(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Roots closer than the vectors can tell apart."""
    power = max(a[1], b[1])
    x, y = a[0] << (power - a[1]), b[0] << (power - b[1])
    return abs(x - y) << (GUARD // 2) <= max(x, y)
