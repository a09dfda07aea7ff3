"""Repeatable pseudo-random keys.

A seeded draw must give the same rows on every run and for every partitioning, so the
operators never call ``rand``; they order or threshold on a hash of (id, seed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the portable mix: prime modulus and multiplier, small enough that the
# product stays far inside a 64-bit integer.
MIX_MODULUS = 1000003
MIX_FACTOR = 7919


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    """64-bit hash of the columns and the seed."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))


def hash_fraction(*cols: Column | str, seed: int = 0) -> Column:
    """Uniform double in [0, 1) from ``stable_hash`` (the top 52 bits)."""
    return F.shiftrightunsigned(stable_hash(*cols, seed=seed), 12) / F.lit(float(1 << 52))


def portable_mix(id_col: Column | str, seed: int = 0) -> Column:
    """Integer mix in [0, 1000003) that any SQL engine can repeat for ids that read as whole
    numbers; other ids are hashed first."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    number = F.coalesce(c.try_cast("long"), F.xxhash64(c))
    inner = F.pmod(number, F.lit(MIX_MODULUS)) * F.lit(MIX_FACTOR) + F.lit(seed)
    return F.pmod(inner, F.lit(MIX_MODULUS)).cast("long")


def portable_fraction(id_col: Column | str, seed: int = 0) -> Column:
    return portable_mix(id_col, seed) / F.lit(float(MIX_MODULUS))


def hash_normal(*cols: Column | str, seed: int = 0) -> Column:
    """Standard normal draw per row (Box-Muller on two hash fractions)."""
    u1 = F.greatest(hash_fraction(*cols, seed=seed), F.lit(1e-16))
    u2 = hash_fraction(*cols, seed=seed + 1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)
