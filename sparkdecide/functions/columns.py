"""Column expressions: costs, states, rates, scores. Only random draws need Python on a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import MIX_A, MIX_B, PROPOSALS, STEP, WORD, beta_draw  # noqa: F401 (the constants are those of the SQL)


def zero(x: Column) -> Column:
    """The value without a negative zero."""
    return x + F.lit(0.0)


def period_cost(y: Column, d: Column, x: Column, h: Column, b: Column, c: Column) -> Column:
    """Realised cost of raising inventory from x to y at demand d: ordering, holding, shortage."""
    nil = F.lit(0).cast("double")
    return c * (y - x) + h * F.greatest(nil, (y - d).cast("double")) + b * F.greatest(nil, (d - y).cast("double"))


def next_state(y: Column, d: Column, x_min: Column, x_max: Column) -> Column:
    """Inventory after demand, kept inside the state range."""
    return F.greatest(x_min, F.least(x_max, y - d))


def nearest_state(x: Column, x_min: Column, x_max: Column) -> Column:
    """Nearest state of a contiguous integer range."""
    return F.greatest(x_min, F.least(x_max, x))


def terminal_value(x: Column, c: Column) -> Column:
    """Value left at the end: stock on hand is worth its cost, with the sign of a cost."""
    return zero(-c * F.greatest(x, F.lit(0)))


def base_stock_level(h: Column, b: Column, c: Column, gamma: Column, d_min: Column, d_max: Column) -> Column:
    """Order-up-to level by linear interpolation of the critical ratio; halves round to even."""
    ratio = (b - (F.lit(1.0) - gamma) * c) / (b + h)
    return F.rint(d_min + (d_max - d_min) * ratio).cast("int")


def is_optimal(arm: Column, best: Column) -> Column:
    return (arm == best).cast("int")


def learning_rate(n: Column, alpha0: float, decay: float = 0.001) -> Column:
    return F.lit(float(alpha0)) / (F.lit(1.0) + F.lit(decay) * n)


def instant_regret(best_prob: Column, prob: Column) -> Column:
    return best_prob - prob


def ucb_score(n: Column, q: Column, t: Column, c: float) -> Column:
    """Upper confidence bound; an arm without pulls is above all. t counts the coming choice."""
    return F.when(n == 0, F.lit(float("inf"))).otherwise(q + F.lit(float(c)) * F.sqrt(F.ln(t) / F.when(n > 0, n)))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on an integer key and the seed alone.

    Two rounds of integer arithmetic that every SQL engine does alike.
    """
    a = F.pmod(F.col("_k") if key is None else key, F.lit(1000003)) * F.lit(48271 + 2 * seed) + F.lit(11 + seed)
    b = F.pmod(F.pmod(a, F.lit(2147483647)) * F.lit(69621), F.lit(2147483647))
    return b.cast("double") / F.lit(2147483647.0)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it, inside any expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def beta_sample(key: Column, alpha: Column, beta: Column, seed: int = 1, stream: Column | None = None) -> Column:
    """A draw of Beta(alpha, beta), both 1 or more, that depends on an integer key, the stream and the seed, not on partitions; null for nulls."""

    def draw(*columns: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
        key, stream, alpha, beta = (c.filter(pa.array(known)).to_numpy(zero_copy_only=False) for c in columns)
        out = np.full(len(known), np.nan)
        out[known] = beta_draw(key, alpha, beta, seed, stream)
        return pa.array(out, pa.float64(), mask=~known)

    parts = (key.cast("long"), (F.lit(0) if stream is None else stream).cast("long"), alpha.cast("double"), beta.cast("double"))
    return F.arrow_udf(draw, "double")(*parts)
