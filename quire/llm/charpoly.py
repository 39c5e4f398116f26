"""Exact eigenvalues of a symmetric integer matrix by its characteristic polynomial, and eigenvectors for them.

The polynomial comes from residues: modulo each of many primes the matrix is reduced to Hessenberg form and its polynomial
read off, and Chinese remaindering puts the coefficients together. Its roots are real, so the sign changes of the shifted
coefficients count those above a point exactly; bisection by that count isolates them, bisection by the polynomial's sign
narrows a single one. Vectors come from inverse iteration near the null space of matrix minus root, in long decimals.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np

#: Bits that a scaled trace has at least, and bits of the interval at which bisection ends: roots are known to 2**-128 of the trace.
SCALE_BITS, END_BITS = 192, 64
#: Decimal digits of inverse iteration.
DIGITS = 110


def _is_prime(n: int) -> bool:
    """For odd n from 9 up to 2**32, by strong tests to the bases 2, 3, 5 and 7."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than bits bits."""
    out, have, n = [], 0, (1 << 31) - 1
    while have <= bits:
        if _is_prime(n):
            out.append(n)
            have += 30
        n -= 2
    return out


def coefficient_bits(trace: int, size: int) -> int:
    """Bits that hold each coefficient, with its sign, of a positive semidefinite matrix: the product of 1 + root is at most (1 + trace / size) ** size."""
    return size * (trace // size + 2).bit_length() + 2


def residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each prime, the leading one first: a row for each prime. matrix holds Python integers."""
    size, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    a = np.array([(matrix % q).astype(np.int64) for q in primes]).reshape(count, size, size)
    p1, p2, each = p[:, None], p[:, None, None], np.arange(count)
    for k in range(size - 2):
        below = a[:, k + 1 :, k] != 0
        pivot = below.argmax(1) + k + 1
        a[each, k + 1], a[each, pivot] = a[each, pivot], a[each, k + 1].copy()
        a[each, :, k + 1], a[each, :, pivot] = a[each, :, pivot], a[each, :, k + 1].copy()
        inverse = np.array([pow(int(x), -1, q) if x else 0 for x, q in zip(a[:, k + 1, k], primes, strict=True)], np.int64)
        factor = a[:, k + 2 :, k] * inverse[:, None] % p1
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1, None, :] % p2) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * factor[:, None, :] % p2).sum(2)) % p1
    minors = np.zeros((size + 1, count, size + 1), np.int64)  # of each leading block, lowest power first
    minors[0, :, 0] = 1
    for k in range(1, size + 1):
        out = np.zeros((count, size + 1), np.int64)
        out[:, 1:] = minors[k - 1, :, :-1]
        out = (out - a[:, k - 1, k - 1, None] * minors[k - 1] % p1) % p1
        chain = np.ones(count, np.int64)
        for i in range(1, k):
            chain = chain * a[:, k - i, k - i - 1] % p
            out = (out - (a[:, k - 1 - i, k - 1] * chain % p)[:, None] * minors[k - 1 - i] % p1) % p1
        minors[k] = out
    return minors[size][:, ::-1]


def combined(rows: list[list[int]], primes: list[int]) -> list[int]:
    """The integers of least magnitude that have these residues; rows hold one list of residues for each prime."""
    whole = 1
    for q in primes:
        whole *= q
    weights = [(whole // q) * pow(whole // q, -1, q) for q in primes]
    sums = (sum(w * int(r) for w, r in zip(weights, column, strict=True)) % whole for column in zip(*rows, strict=True))
    return [x - whole if 2 * x > whole else x for x in sums]


def _above(poly: list[int], point: int) -> int:
    """How many roots lie above point: the sign changes of poly(x + point), which is exact as all roots are real."""
    c = list(poly)
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += c[i - 1] * point
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _positive(poly: list[int], point: int) -> bool:
    value = 0
    for c in poly:
        value = value * point + c
    return value > 0


def roots(poly: list[int], trace: int, want: int) -> list[tuple[int, int, int]]:
    """(scaled root, bits of the scale, multiplicity) of the largest roots, falling, of a polynomial without negative roots.

    Goes on until want roots are counted. Roots nearer than 2**-128 of the trace count as one. A zero root is exact.
    """
    size = len(poly) - 1
    zeros = next(i for i, c in enumerate(reversed(poly)) if c)
    poly = poly[: len(poly) - zeros]
    scale = max(0, SCALE_BITS - trace.bit_length())
    poly = [c << (scale * k) for k, c in enumerate(poly)]
    found, counted, top = [], 0, 1 << (trace.bit_length() + scale)
    open_ = [(0, top, size - zeros, 0)] if size > zeros else []  # low, high, roots above low, roots above high
    least = 1 << max(END_BITS, trace.bit_length() + scale - 128)
    while open_ and counted < want:
        low, high, below, above = open_.pop()
        if below - above == 1:
            side = below % 2 == 0  # the sign just above low, as the leading coefficient is positive
            while high - low > least:
                mid = (low + high) // 2
                low, high = (mid, high) if _positive(poly, mid) == side else (low, mid)
        if high - low <= least:
            found.append(((low + high) // 2, scale, below - above))
            counted += below - above
            continue
        mid = (low + high) // 2
        middle = _above(poly, mid)
        if below > middle:
            open_.append((low, mid, below, middle))
        if middle > above:
            open_.append((mid, high, middle, above))
    if counted < want and zeros:
        found.append((0, scale, zeros))
    return found


def eigenvectors(matrix: np.ndarray, root: int, scale: int, multiplicity: int) -> np.ndarray:
    """Orthonormal rows that span the null space of matrix - root / 2**scale, as doubles; the largest entry of each is positive.

    Inverse iteration: the shift is so near to the root that two steps leave nothing of other directions.
    """
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        context.Emin, context.Emax = -999_999, 999_999
        shift, tiny = Decimal(root) / Decimal(1 << scale), Decimal(10) ** (-DIGITS // 2)
        rows = [[Decimal(int(x)) - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        unit = max((abs(x) for row in rows for x in row), default=Decimal(1)) or Decimal(1)
        draws = np.random.default_rng(multiplicity).integers(-1000, 1000, (multiplicity, size))
        right = [[Decimal(int(x)) for x in column] for column in draws.T]
        order, lower = list(range(size)), [[Decimal(0)] * size for _ in range(size)]
        for k in range(size):
            best = max(range(k, size), key=lambda i: abs(rows[i][k]))
            for swapped in (rows, lower, order):
                swapped[k], swapped[best] = swapped[best], swapped[k]
            if abs(rows[k][k]) < unit * tiny:
                rows[k][k] = unit * tiny
            top, head = rows[k], rows[k][k]
            for i in range(k + 1, size):
                if rows[i][k]:
                    factor = lower[i][k] = rows[i][k] / head
                    row = rows[i]
                    for j in range(k + 1, size):
                        row[j] -= factor * top[j]
        for _ in range(3):
            solved = []
            for v in range(multiplicity):
                x = [right[order[i]][v] for i in range(size)]
                for i in range(size):
                    x[i] -= sum((lower[i][j] * x[j] for j in range(i)), Decimal(0))
                for i in reversed(range(size)):
                    x[i] = (x[i] - sum((rows[i][j] * x[j] for j in range(i + 1, size)), Decimal(0))) / rows[i][i]
                for _again in range(2):
                    for y in solved:
                        dot = sum(p * q for p, q in zip(x, y, strict=True))
                        x = [p - dot * q for p, q in zip(x, y, strict=True)]
                    norm = sum(p * p for p in x).sqrt()
                    x = [p / norm for p in x]
                solved.append(x)
            right = [[solved[v][i] for v in range(multiplicity)] for i in range(size)]
        out = np.array([[float(x) for x in row] for row in solved]).reshape(multiplicity, size)
    sign = np.sign(out[np.arange(multiplicity), np.abs(out).argmax(1)])
    return out * sign[:, None]
