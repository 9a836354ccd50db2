"""Repeatable pseudo-random numbers from a key, the same in Spark and in plain SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# A linear congruential step and its modulus.
MULTIPLIER = 1103515245
INCREMENT = 12345
MODULUS = 2147483648


def _step(x: Column) -> Column:
    return (x * MULTIPLIER + INCREMENT) % MODULUS


def _swap(x: Column) -> Column:
    """Exchange the high and the low bits: the low bits of a congruential step are poor."""
    return F.shiftright(x, 16) + (x % 65536) * 32768


def key_hash(key: Column, seed: int = 0) -> Column:
    """A BIGINT in ``[0, 2**31)``.

    Keys are folded first so that no multiplication can overflow. The seed enters by exclusive
    or between two steps, so that numbers of different seeds are unrelated.
    """
    salt = (seed * MULTIPLIER + INCREMENT) % MODULUS
    first = _swap(_step(F.pmod(key, F.lit(MODULUS))))
    return _step(_swap(_step(first.bitwiseXOR(F.lit(salt).cast("long")))))


def uniform(key: Column, seed: int = 0) -> Column:
    return key_hash(key, seed).cast("double") / F.lit(float(MODULUS))


def poisson_weight(key: Column, seed: int = 0, top: int = 12) -> Column:
    """A Poisson(1) count per row: how often a bootstrap sample would draw it."""
    u = uniform(key, seed)
    cumulative, weight = 0.0, F.lit(0)
    for k in range(top):
        cumulative += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u >= F.lit(cumulative), 1).otherwise(0)
    return weight
