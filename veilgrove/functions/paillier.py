"""Additively homomorphic encryption as column functions.

A ciphertext is a string column ``"<c in hex>:<exponent>"``: Spark has no type
for integers of that size, and Arrow carries strings in batches.  A number is
encoded as mantissa * 16^exponent, negatives in the upper third of the range and
nothing in the middle, so an overflow shows.  Sums multiply ciphertexts; partial
products are made before the shuffle.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from veilgrove.functions.numbers import inverse, prime_of

BASE = 16


class PublicKey(NamedTuple):
    n: int
    g: int

    @property
    def n2(self) -> int:
        return self.n * self.n

    @property
    def largest(self) -> int:
        return self.n // 3 - 1


class SecretKey(NamedTuple):
    """``p`` and ``q`` are the primes, with which the owner computes modulo their squares; 0 where they are not known."""

    public: PublicKey
    lam: int
    mu: int
    p: int = 0
    q: int = 0


class Cipher(NamedTuple):
    c: int
    exponent: int

    def text(self) -> str:
        return f"{self.c:x}:{self.exponent}"

    @staticmethod
    def of(text: str) -> Cipher:
        c, e = text.split(":")
        return Cipher(int(c, 16), int(e))


def keypair(bits: int = 512, seed: int | None = None) -> tuple[PublicKey, SecretKey]:
    """Keys of two distinct primes of ``bits`` bits; g = n + 1."""
    rng = random.Random(seed) if seed is not None else random.SystemRandom()
    p = q = prime_of(bits, rng)
    while q == p or math.gcd(p * q, (p - 1) * (q - 1)) != 1:
        q = prime_of(bits, rng)
    return keys_of(p, q)


def keys_of(p: int, q: int, k: int = 1) -> tuple[PublicKey, SecretKey]:
    n = p * q
    pub = PublicKey(n, 1 + k * n)
    lam = math.lcm(p - 1, q - 1)
    return pub, SecretKey(pub, lam, inverse((pow(pub.g, lam, pub.n2) - 1) // n, n), p, q)


def encode(pub: PublicKey, value: float | int, precision: float | None = None) -> tuple[int, int]:
    """Mantissa modulo n, and exponent."""
    if isinstance(value, int):
        exponent = 0 if precision is None else math.floor(math.log(precision, BASE))
        mantissa = value * BASE ** max(0, -exponent)
        exponent = min(exponent, 0)
    else:
        least = math.floor((math.frexp(value)[1] - 53) / math.log2(BASE)) if precision is None else math.floor(math.log(precision, BASE))
        exponent = min(least, 0)
        mantissa = round(value * float(BASE) ** -exponent)
    if abs(mantissa) > pub.largest:
        raise OverflowError(f"{value} does not fit the key")
    return mantissa % pub.n, exponent


def decode(pub: PublicKey, m: int, exponent: int) -> float:
    if m > pub.n - pub.largest - 1:
        m -= pub.n
    elif m > pub.largest:
        raise OverflowError("a sum has left the range of the key")
    return m * float(BASE) ** exponent if exponent else m


def _power_of_g(pub: PublicKey, m: int) -> int:
    """g^m: for g = 1 + k n the binomial series ends after its second term modulo n squared."""
    k, rest = divmod(pub.g - 1, pub.n)
    return (1 + k * m % pub.n * pub.n) % pub.n2 if not rest else pow(pub.g, m, pub.n2)


class _Noise:
    """r^n for random r: modulo n squared, or for the owner modulo the squares of both primes, put together."""

    def __init__(self, pub: PublicKey, sec: SecretKey | None = None, rng: random.Random | None = None) -> None:
        self.pub, self.rng = pub, rng or random.SystemRandom()
        self.owner = bool(sec and sec.p)
        if self.owner:
            self.p2, self.q2 = sec.p**2, sec.q**2
            self.p, self.q = sec.p, sec.q
            self.ep, self.eq = pub.n % (sec.p * (sec.p - 1)), pub.n % (sec.q * (sec.q - 1))
            self.back = inverse(self.p2 % self.q2, self.q2)

    def __call__(self) -> int:
        n = self.pub.n
        while True:
            r = self.rng.randrange(1, n)
            if not self.owner:
                if math.gcd(r, n) == 1:
                    return pow(r, n, self.pub.n2)
            elif r % self.p and r % self.q:
                a, b = pow(r, self.ep, self.p2), pow(r, self.eq, self.q2)
                return a + (b - a) * self.back % self.q2 * self.p2


def seal(pub: PublicKey, value: float | int, rng: random.Random | None = None, precision: float | None = None, noise: _Noise | None = None) -> Cipher:
    m, e = encode(pub, value, precision)
    return Cipher(_power_of_g(pub, m) * (noise or _Noise(pub, rng=rng))() % pub.n2, e)


def open_(sec: SecretKey, x: Cipher) -> float:
    pub = sec.public
    m = (pow(x.c, sec.lam, pub.n2) - 1) // pub.n * sec.mu % pub.n
    return decode(pub, m, x.exponent)


def lower(pub: PublicKey, x: Cipher, exponent: int) -> Cipher:
    """The same value at a smaller exponent."""
    return x if exponent >= x.exponent else Cipher(pow(x.c, BASE ** (x.exponent - exponent), pub.n2), exponent)


def plus(pub: PublicKey, x: Cipher, y: Cipher) -> Cipher:
    e = min(x.exponent, y.exponent)
    return Cipher(lower(pub, x, e).c * lower(pub, y, e).c % pub.n2, e)


def plus_plain(pub: PublicKey, x: Cipher, value: float | int) -> Cipher:
    m, e = encode(pub, value)
    return plus(pub, x, Cipher(_power_of_g(pub, m), e))


def times(pub: PublicKey, x: Cipher, value: float | int) -> Cipher:
    m, e = encode(pub, value)
    if m > pub.n - pub.largest - 1:  # a negative factor: a small power of the inverse
        return Cipher(pow(inverse(x.c, pub.n2), pub.n - m, pub.n2), x.exponent + e)
    return Cipher(pow(x.c, m, pub.n2), x.exponent + e)


def blind(pub: PublicKey, x: Cipher, rng: random.Random | None = None) -> Cipher:
    """Another ciphertext of the same value."""
    r = (rng or random.SystemRandom()).randrange(1, pub.n)
    return Cipher(x.c * pow(r, pub.n, pub.n2) % pub.n2, x.exponent)


# -- columns -------------------------------------------------------------------------------------
def _each(f: Callable, kind: str) -> Callable:
    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x != x else f(x))

    return run


def encrypt(pub: PublicKey, precision: float | None = None, sec: SecretKey | None = None) -> Callable:
    """Sealing of a number column; the owner, who has ``sec``, seals several times as fast."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        noise = _Noise(pub, sec)
        whole = lambda x: seal(pub, int(x) if float(x).is_integer() else float(x), precision=precision, noise=noise).text()
        return pd.Series([None if x is None or x != x else whole(x) for x in s.tolist()], dtype=object)

    return run.asNondeterministic()


def decrypt(sec: SecretKey) -> Callable:
    return _each(lambda t: float(open_(sec, Cipher.of(t))), "double")


def add_plain(pub: PublicKey, value: float | int) -> Callable:
    return _each(lambda t: plus_plain(pub, Cipher.of(t), value).text(), "string")


def multiply(pub: PublicKey, value: float | int) -> Callable:
    return _each(lambda t: times(pub, Cipher.of(t), value).text(), "string")


def reblind(pub: PublicKey) -> Callable:
    return _each(lambda t: blind(pub, Cipher.of(t)).text(), "string").asNondeterministic()


def add(pub: PublicKey) -> Callable:
    @pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else plus(pub, Cipher.of(x), Cipher.of(y)).text() for x, y in zip(a, b, strict=True)])

    return run


def sums_by(df: DataFrame, keys: list[str], cols: list[str], pub: PublicKey) -> DataFrame:
    """n and the encrypted sum of each column, by key: one pass, products within a task first, one row a key and task is shuffled."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for b in batches:
            values = [[None if t is None else Cipher.of(t) for t in b[c].tolist()] for c in cols]
            for k, *row in zip(zip(*[b[c].tolist() for c in keys], strict=True) if keys else [()] * len(b), *values, strict=True):
                own = total.get(k)
                if own is None:
                    total[k] = [1, *row]
                    continue
                own[0] += 1
                for i, x in enumerate(row, 1):
                    if x is not None:
                        own[i] = x if own[i] is None else plus(pub, own[i], x)
        yield pd.DataFrame([(*k, v[0], *[None if x is None else x.text() for x in v[1:]]) for k, v in total.items()], columns=[*keys, "n", *cols])

    src = df.select(*keys, *cols)
    kinds = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keys], "n bigint", *[f"`{c}` string" for c in cols]])
    return sums_of(src.mapInPandas(partial, kinds), keys, cols, pub)


def sums_of(parts: DataFrame, keys: list[str], cols: list[str], pub: PublicKey) -> DataFrame:
    """keys, n, cols: sums of n and products of the ciphertexts of the tasks' rows, in one shuffle."""

    @pandas_udf("string")
    def product(s: pd.Series) -> str:
        out = None
        for t in s.dropna():
            out = Cipher.of(t) if out is None else plus(pub, out, Cipher.of(t))
        return out.text() if out else None

    @pandas_udf("bigint")
    def count(s: pd.Series) -> int:
        return int(s.sum())

    return parts.groupBy(*keys).agg(count("n").alias("n"), *[product(c).alias(c) for c in cols])


def sum_by(df: DataFrame, keys: list[str], col: str, pub: PublicKey) -> DataFrame:
    """Encrypted sum of each key."""
    return sums_by(df, keys, [col], pub).select(*keys, col)
