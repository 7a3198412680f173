"""Counter-based uniform draws.

A draw depends only on (seed, step, which), so a retried task repeats it and SQL can
compute it with the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mixing weights and the multiplier and modulus of the generator.
SEED_WEIGHT, STEP_WEIGHT, WHICH_WEIGHT, OFFSET = 7919, 104729, 1299709, 12345
MULTIPLIER, INCREMENT, MODULUS, ROUNDS = 48271, 11, 2147483647, 3


def _mix(seed, step, which):
    x = (seed * SEED_WEIGHT + step * STEP_WEIGHT + which * WHICH_WEIGHT + OFFSET) % MODULUS
    for _ in range(ROUNDS):
        x = (x * MULTIPLIER + INCREMENT) % MODULUS
    return x


def uniform(seed: int, step: int, which: int) -> float:
    """A number in [0, 1)."""
    return _mix(seed, step, which) / MODULUS


def uniform_column(seed, step, which: int) -> Column:
    return _mix(F.col(seed).cast("long"), F.col(step).cast("long"), which) / F.lit(float(MODULUS))


def uniform_sql(seed: str, step: str, which: int) -> str:
    x = f"(({seed}) * {SEED_WEIGHT} + ({step}) * {STEP_WEIGHT} + {which * WHICH_WEIGHT + OFFSET}) % {MODULUS}"
    for _ in range(ROUNDS):
        x = f"(({x}) * {MULTIPLIER} + {INCREMENT}) % {MODULUS}"
    return f"(({x}) / {MODULUS}.0::DOUBLE)"
