"""Vector functions, Column -> Column, of built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import values as V


def dot(a: Column, b: Column) -> Column:
    """Inner product over the components both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    return T.let(norm(a) * norm(b), lambda size: F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0))))


def normalize(a: Column) -> Column:
    """Of length 1; as it is below 1e-12."""
    return T.let(F.struct(norm(a).alias("size"), a.alias("v")), lambda s: F.when(s["size"] < 1e-12, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["size"])))


def hashed_values(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    """A linear congruential sequence in [-1, 1] seeded by the low 32 bits of the text's MD5.

    State n is factor * seed + step for constants of n alone, so every component is an expression of its own. The product
    is taken in two halves of the seed, which keeps it below 2**63.
    """
    factor, step, constants = 1, 0, []
    for _ in range(dim):
        factor, step = factor * V.LCG_FACTOR % V.LCG_SIZE, (step * V.LCG_FACTOR + V.LCG_STEP) % V.LCG_SIZE
        constants.append(F.struct(F.lit(factor).cast("bigint").alias("a"), F.lit(step).cast("bigint").alias("c")))
    high, low = (F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("bigint") for at in (25, 29))
    halves = F.transform(F.array(F.struct(high.alias("high"), low.alias("low"))), lambda h: F.transform(F.array(*constants), lambda x: (x["a"] * h["low"] + x["a"] * h["high"] % 65536 * 65536 + x["c"]) % V.LCG_SIZE))
    return F.transform(F.flatten(halves), lambda s: s.cast("double") / float(V.LCG_SIZE - 1) * 2 - 1)
