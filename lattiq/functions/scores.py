"""Scalar scores and vector arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number of values that a draw may have.
HASHES = 1_000_003
#: Prime of the two residues of which a wide draw is made.
PRIME = 2**31 - 1


def small_world(ratio: Column) -> Column:
    """Clustering ratio to [0, 1], logarithmic up to 1000; 0 at or below 1."""
    return F.when(ratio > 1, F.least(F.lit(1.0), F.ln(ratio) / math.log(1000.0))).otherwise(0.0)


def differential_resilience(guided: Column, random: Column) -> Column:
    return F.greatest(F.lit(0.0), (guided - random) / F.greatest(F.lit(1e-6), 1 - random))


def effect_size(r: Column) -> Column:
    """Common-language effect size of a rank correlation; 0 where it is undefined."""
    return F.coalesce((r + 1) / 2, F.lit(0.0))


def traceability(sources: Column) -> Column:
    """Score of a provenance tier: none, documented, attributed by edge."""
    return F.when(sources >= 2, 1.0).when(sources == 1, 0.5).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a divided by its length; unchanged where that is 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def translation_score(h: Column, r: Column, t: Column) -> Column:
    """Minus the Euclidean distance of h + r and t."""
    d = F.zip_with(F.zip_with(h, r, lambda x, y: x.cast("double") + y.cast("double")), t, lambda x, y: x - y.cast("double"))
    return -norm(d)


def rotation_score(h: Column, phase: Column, t: Column, size: int) -> Column:
    """Minus the distance of h turned by phase and t; h and t hold size real parts, then size imaginary ones."""
    parts = []
    for i in range(1, size + 1):
        hr, hi, tr, ti = (F.element_at(x, F.lit(i + o)).cast("double") for x, o in ((h, 0), (h, size), (t, 0), (t, size)))
        c, s = F.cos(F.element_at(phase, F.lit(i)).cast("double")), F.sin(F.element_at(phase, F.lit(i)).cast("double"))
        re, im = hr * c - hi * s - tr, hr * s + hi * c - ti
        parts.append(re * re + im * im)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return -F.sqrt(total + 1e-12)


def hashed(*terms: Column, seed: int = 42) -> Column:
    """A draw in [0, 1000003) by integer arithmetic that any engine repeats: a linear hash and one squaring round."""
    factors = (7919, 104729, 15485863)
    h = F.lit(seed * 1299709)
    for f, t in zip(factors, terms):
        h = h + t.cast("bigint") * f
    h = F.pmod(h, F.lit(1000003))
    return F.pmod(h * h + h * 31 + seed, F.lit(1000003))


def hashed_array(*terms, seed: int = 42):
    """The draws of hashed() for integers and integer arrays."""
    h = seed * 1299709
    for f, t in zip((7919, 104729, 15485863), terms):
        h = h + t * f
    h = h % HASHES
    return (h * h + h * 31 + seed) % HASHES


def _residues(x):
    """x modulo PRIME, for arrays of 0 .. 2**62."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    x[x == PRIME] = 0
    return x


def _fifth(x):
    """Fifth powers modulo PRIME, which permute its residues."""
    square = _residues(x * x)
    return _residues(_residues(square * square) * x)


def wide_array(boot: int, draws, stratum: int, seed: int = 42):
    """Draws in [0, 2**62) for an integer array draws, by integer arithmetic that any engine repeats.

    Those of hashed() have 1000003 values, half of which never come out; here none is left out or likelier than another."""
    x = _fifth(_residues(draws * 16807 + (seed * 1299709 + boot * 48271 + stratum * 69621)))
    return x * PRIME + _fifth(_residues(x * 1000003 + draws * 48271 + boot * 16807))


# --- tails of distributions, for the single numbers of a finished test --------------------------------------------


def _continued(step, most: int = 500) -> float:
    """A continued fraction by Lentz's method; step(i) gives its i-th (numerator, denominator)."""
    tiny = 1e-300
    f = c = step(0)[1] or tiny
    d = 0.0
    for i in range(1, most):
        a, b = step(i)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X > x) of a chi-square variable; 1 at or below 0."""
    if x <= 0:
        return 1.0
    a, y = freedom / 2, x / 2
    scale = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= y / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - scale * total)
    return scale / _continued(lambda i: (i * (a - i), y + 2 * i + 1 - a))


def _beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a

    def step(i: int) -> tuple[float, float]:
        if i == 0:
            return 0.0, 1.0
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return front / _continued(step)


def t_tails(t: float, freedom: float) -> float:
    """P(|T| > |t|) of Student's t."""
    return _beta_part(freedom / 2, 0.5, freedom / (freedom + t * t))


def kruskal_p(h: float, groups: int) -> float | None:
    """p of a Kruskal-Wallis statistic; None below two groups."""
    return chi_square_tail(h, groups - 1) if groups > 1 and h is not None else None


def correlation_p(rho: float, n: int) -> float | None:
    """Two-sided p of a rank correlation of n pairs; None below three."""
    if rho is None or n < 3:
        return None
    return 0.0 if abs(rho) >= 1 else t_tails(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
