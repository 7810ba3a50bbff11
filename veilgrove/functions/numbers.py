"""Number theory on arbitrary integers, and its column functions over Arrow batches."""

from __future__ import annotations

import math
import random

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

ColumnOrName = Column | str

#: Bases that decide primality below 3,317,044,064,679,887,385,961,981.
_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
_SURE = 3_317_044_064_679_887_385_961_981


def is_prime(n: int, rounds: int = 40) -> bool:
    """Miller and Rabin's test: certain below a bound, with random bases above it."""
    if n < 2:
        return False
    for p in _BASES:
        if n % p == 0:
            return n == p
    s = (n - 1 & 1 - n).bit_length() - 1
    d = n - 1 >> s
    bases = _BASES if n < _SURE else [random.Random(n ^ k).randrange(2, n - 1) for k in range(rounds)]
    for a in bases:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def prime_of(bits: int, rng: random.Random) -> int:
    """A prime of exactly that many bits."""
    if bits < 2:
        raise ValueError("primes have two bits at least")
    while True:
        n = rng.getrandbits(bits) | 1 << bits - 1 | (bits > 2)
        if is_prime(n):
            return n


def extended_gcd(a: int, b: int) -> tuple[int, int, int]:
    """g, x, y with a*x + b*y = g."""
    x, u = 1, 0
    y, v = 0, 1
    while b:
        q = a // b
        a, b = b, a - q * b
        x, u = u, x - q * u
        y, v = v, y - q * v
    return (a, x, y) if a >= 0 else (-a, -x, -y)


def inverse(a: int, m: int) -> int:
    """The inverse of a modulo m, 0 if there is none."""
    g, x, _ = extended_gcd(a % m, m)
    return x % m if g == 1 else 0


def positive_mod(a: int, m: int) -> int:
    return a % m


# -- columns: made when they are called, since workers import this module too ------------------------
def _column(f: Callable, kind: str, *cols: ColumnOrName) -> Column:
    @pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else f(*map(int, row)) for row in zip(*series, strict=True)], dtype="object")

    return run(*cols)


def is_prime_udf(n: ColumnOrName) -> Column:
    return _column(is_prime, "boolean", n)


def gcd_udf(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _column(math.gcd, "long", a, b)


def lcm_udf(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _column(math.lcm, "long", a, b)


def modpow_udf(a: ColumnOrName, e: ColumnOrName, m: ColumnOrName) -> Column:
    return _column(pow, "long", a, e, m)


def inverse_udf(a: ColumnOrName, m: ColumnOrName) -> Column:
    return _column(inverse, "long", a, m)
