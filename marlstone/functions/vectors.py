"""Scalar, vector and container functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the multiplicative generator: multiplier, modulus and scale.
LCG_A, LCG_M, LCG_SCALE = 16807, 2147483647, 4.656612875e-10


def larger(x: Column, y: Column) -> Column:
    """x where y < x, else y (so a NaN on either side gives y)."""
    return F.when(F.isnan(x) | F.isnan(y), y).when(y < x, x).otherwise(y)


def smaller(x: Column, y: Column) -> Column:
    """y where y < x, else x (so a NaN on either side gives x)."""
    return F.when(F.isnan(x) | F.isnan(y), x).when(y < x, y).otherwise(x)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def sign_test(a: Column, b: Column) -> Column:
    """-1, 0 or 1: whether two numbers have opposite signs, one is zero, or the same sign."""
    return F.signum(a) * F.signum(b)


def soft_threshold(x: Column, by: Column) -> Column:
    """Shrink toward 0."""
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def momentum(level: Column) -> Column:
    """Heavy-ball momentum for a penalty level (fixed break points and slopes)."""
    return F.when(level < 0.65, (0.65 - level) * 0.35 + 0.75).when(level <= 0.80, 0.75 - 4 * (level - 0.65)).otherwise((1 - level) / 2)


def even_grid(n: Column, low: Column, high: Column) -> Column:
    """n evenly spaced values from low to high; one value is the midpoint."""
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: (low * (n - 1 - k) + high * k) / F.greatest(n - 1, F.lit(1)))
    return F.when(n == 1, F.array((low + high) / 2)).otherwise(grid)


def ones_up(n: Column) -> Column:
    return F.sequence(F.lit(1), n)


def lcg_next(seed: Column) -> Column:
    return (seed.cast("long") * LCG_A) % LCG_M


def lcg_uniforms(seed: Column, n: Column) -> Column:
    """n uniforms in (0, 1) from a seed, as an array; each follows from the one before."""
    start = F.struct(seed.cast("long").alias("s"), F.array().cast("array<double>").alias("u"))

    def step(a: Column, _: Column) -> Column:
        s = lcg_next(a["s"])
        return F.struct(s.alias("s"), F.array_append(a["u"], s * LCG_SCALE).alias("u"))

    return F.aggregate(ones_up(n), start, step, lambda a: a["u"])


def lcg_state(seed: Column, k: Column, bits: int = 40) -> Column:
    """The generator's state k steps (below 2^bits) after a seed, without the states between.

    k steps multiply by the k-th power of the factor, put together from its
    squares by the bits of k; all products stay below 2^62.
    """
    state, power = seed.cast("long") % LCG_M, LCG_A
    for bit in range(bits):
        step = F.when(F.shiftright(k.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(power).cast("long")).otherwise(F.lit(1).cast("long"))
        state, power = (state * step) % LCG_M, power * power % LCG_M
    return state


def lcg_sequence(spark: SparkSession, seed: int, n: int, low: float = 0.0, high: float = 1.0, parts: int | None = None) -> DataFrame:
    """``(k, u)``: uniforms 1 to n of one sequence; every task starts where its numbers do."""
    u = lcg_state(F.lit(seed), F.col("id")) * LCG_SCALE
    return spark.range(1, n + 1, 1, parts).select(F.col("id").alias("k"), (low + (high - low) * u).alias("u"))


def lcg_between(seed: Column, n: Column, low: Column, high: Column) -> Column:
    return F.transform(lcg_uniforms(seed, n), lambda u: low + (high - low) * u)


def random_integers(seed: Column, n: Column) -> Column:
    """n whole numbers from 1 to 2^31 - 2, the states of the generator behind :func:`lcg_uniforms`."""
    return F.transform(lcg_uniforms(seed, n), lambda u: F.round(u / LCG_SCALE).cast("long"))


def random_tridiagonal(seed: Column, n: int) -> Column:
    """Rows (i, sub, diag, sup) of an n x n tridiagonal matrix of uniforms; what lies outside the matrix is 0."""
    u = lcg_uniforms(seed, F.lit(3 * n))
    at = lambda i, k: F.get(u, 3 * i + k)
    row = lambda i: F.struct(i.alias("i"), F.when(i == 0, 0.0).otherwise(at(i, 0)).alias("sub"), at(i, 1).alias("diag"), F.when(i == n - 1, 0.0).otherwise(at(i, 2)).alias("sup"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row)


def trimmed_length(s: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(s))


def string_hash(s: Column) -> Column:
    """``h * 33 + c`` over the characters' codes from 0, modulo 2^32."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32))


def order_type(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """``(group, order_type)``: -1 unordered, 0 all equal, 1 ascending, 2 strictly ascending, 3 descending, 4 strictly descending."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(position))
    low, high, equal = F.min("step"), F.max("step"), F.coalesce(F.bool_or(F.col("step") == 0), F.lit(False))
    steps = df.select(group, step.alias("step")).groupBy(group).agg(low.alias("low"), high.alias("high"), equal.alias("equal"))
    kind = (
        F.when(F.col("low").isNull() | ((F.col("low") == 0) & (F.col("high") == 0)), 0)
        .when(F.col("low") > 0, 2)
        .when((F.col("low") == 0) & (F.col("high") > 0), 1)
        .when(F.col("high") < 0, 4)
        .when((F.col("high") == 0) & (F.col("low") < 0), 3)
        .otherwise(-1)
    )
    return steps.select(group, kind.alias("order_type"))


def lookup(m: Column, key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, default)


def stored_key(m: Column, key: Column) -> Column:
    return F.when(F.map_contains_key(m, key), key)


def put(m: Column, key: Column, value: Column) -> Column:
    """Set a key; an earlier value is replaced."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def drop_key(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_of(df: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """``(group, m)``: a map of each group's keys; of repeated keys the last by ``order`` wins."""
    last = df.groupBy(group, key).agg(F.max_by(value, order).alias(value))
    return last.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("m"))


def push_front(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def push_back(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def truncate(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def first_by_group(df: DataFrame, group: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The first n rows of each group; a rank that Spark cuts off before and after the shuffle, so no group is gathered."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def delete_at(a: Column, k: int) -> Column:
    """Without element k (0 up)."""
    return F.concat(F.slice(a, 1, k), F.slice(a, k + 2, F.greatest(F.size(a) - k - 1, F.lit(0))))
