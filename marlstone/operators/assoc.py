"""Association of binned counts with a sample's dosage, permutation p-values, false discovery rate.

The statistic is this engine's own: the L2 norm of the counts' residuals about
one mean, over that about an additive fit in the dosage (``ratio >= 1``). It
needs five sums a bin, so bins are scored by one partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import ranges


def additive_ratio(x: Column, y: Column) -> Column:
    """sqrt(Syy / (Syy - Sxy^2 / Sxx)) as an aggregate; 1 where x or y does not vary, infinite for an exact fit."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.sum(F.when(both, x)), F.sum(F.when(both, y))
    sxx = F.sum(F.when(both, x * x)) - sx * sx / n
    syy = F.sum(F.when(both, y * y)) - sy * sy / n
    sxy = F.sum(F.when(both, x * y)) - sx * sy / n
    left = syy - sxy * sxy / F.when(sxx > 1e-12, sxx)
    return F.when((n == 0) | (sxx <= 1e-12) | (syy <= 1e-12), F.lit(1.0)).when(left <= 1e-12 * syy, F.lit(float("inf"))).otherwise(F.sqrt(syy / F.when(left > 0, left)))


def additive_effect(x: Column, y: Column) -> Column:
    """|Sxy / Sxx|, the change of y for each allele, as an aggregate; 0 where x does not vary."""
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, 1))
    sx, sy = F.sum(F.when(both, x)), F.sum(F.when(both, y))
    sxx = F.sum(F.when(both, x * x)) - sx * sx / F.nullif(n, F.lit(0))
    sxy = F.sum(F.when(both, x * y)) - sx * sy / F.nullif(n, F.lit(0))
    return F.when(sxx > 1e-12, F.abs(sxy / F.when(sxx > 1e-12, sxx))).otherwise(F.lit(0.0))


def score_bins(counts: DataFrame, by: tuple[str, ...] = ("bin",), dosage: str = "dosage", n: str = "n") -> DataFrame:
    """``(*by, ratio)`` of counts by bin and sample (samples without a count must be present with 0)."""
    return counts.groupBy(*by).agg(additive_ratio(F.col(dosage).cast("double"), F.col(n).cast("double")).alias("ratio"))


def score_counts(counts: DataFrame, samples: DataFrame, bins: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, bin, ratio, effect, mean)`` of every bin over all samples, those without a count being 0.

    ``counts`` (bin, sample, n) holds what was counted, ``samples`` (*by,
    sample, dosage) each sample once. Zeros add nothing to the sums of y, y*y
    and x*y, and n and the sums of x and x*x are the same for all bins, so no
    grid of bins and samples is made.
    """
    x, y = F.col("dosage").cast("double"), F.col("n").cast("double")
    known, totals = _known(samples, by)
    found = counts.join(known, "sample").groupBy(*by, "bin").agg(F.sum(y).alias("_sy"), F.sum(y * y).alias("_syy"), F.sum(x * y).alias("_sxy"))
    table = bins.select("bin").distinct().join(F.broadcast(totals)).join(found, [*by, "bin"], "left").na.fill(0.0, ["_sy", "_syy", "_sxy"])
    return _scored(table, by)


def _known(samples: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The samples with a dosage, and their number and sums."""
    x = F.col("dosage").cast("double")
    known = samples.where(x.isNotNull()).select(*by, "sample", x.alias("dosage"))
    return known, known.groupBy(*by).agg(F.count("*").alias("_k"), F.sum(x).alias("_sx"), F.sum(x * x).alias("_sxx")).where("_k > 0")


def _scored(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The scores of each bin from its sums."""
    n, sx, sy = F.col("_k"), F.col("_sx"), F.col("_sy")
    sxx, syy, sxy = F.col("_sxx") - sx * sx / n, F.col("_syy") - sy * sy / n, F.col("_sxy") - sx * sy / n
    left = syy - sxy * sxy / F.when(sxx > 1e-12, sxx)
    ratio = F.when((sxx <= 1e-12) | (syy <= 1e-12), F.lit(1.0)).when(left <= 1e-12 * syy, F.lit(float("inf"))).otherwise(F.sqrt(syy / F.when(left > 0, left)))
    effect = F.when(sxx > 1e-12, F.abs(sxy / F.when(sxx > 1e-12, sxx))).otherwise(F.lit(0.0))
    return table.select(*by, "bin", ratio.alias("ratio"), effect.alias("effect"), (sy / n).alias("mean"))


def score_steps(steps: DataFrame, samples: DataFrame, bins: DataFrame, by: tuple[str, ...] = (), size: int = ranges.ROWS) -> DataFrame:
    """What :func:`score_counts` gives, from the changes of the counts (sample, bin, step), as of ``intervals.bin_steps``.

    A sample's count is the running sum of its changes; how each changes the
    three sums over all samples is added up by bin, and the sums themselves are
    running sums over the bins. So no row is made for a sample in each bin that
    covers its points, and no task aggregates by sample and bin.
    """
    known, totals = _known(samples, by)
    y = F.sum("step").over(Window.partitionBy("sample").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    moved = steps.select("sample", "bin", "step", y.alias("_y")).join(known, "sample")
    grown = moved.groupBy(*by, "bin").agg(F.sum("step").alias("_dy"), F.sum(F.col("step") * (2 * F.col("_y") - F.col("step"))).alias("_dyy"), F.sum(F.col("dosage") * F.col("step")).alias("_dxy"))
    asked = bins.select("bin").distinct().join(F.broadcast(totals)).select("*", F.lit(1).alias("_ask"))
    rows = grown.withColumn("_ask", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    rows = ranges.stored(rows.select("*", F.struct(F.lit(0).alias("_"), *by).alias("_grp"), F.col("bin").cast("double").alias("_at")))
    table = ranges.running(rows, "_grp", "_at", {f"_s{c}": F.col(f"_d{c}") for c in ("y", "yy", "xy")}, size, order=["bin", "_ask"]).where("_ask = 1")
    return _scored(table.select(*by, "bin", "_k", "_sx", "_sxx", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("_sy", "_syy", "_sxy"))), by)


def complete(counts: DataFrame, samples: DataFrame, bins: DataFrame, keys: tuple[str, ...] = ("bin", "sample")) -> DataFrame:
    """Every bin of ``bins`` for every sample, with 0 where nothing was counted: a product, for output only (``score_counts`` needs no grid)."""
    grid = bins.select("bin").distinct().crossJoin(samples.select("sample").distinct())
    return grid.join(counts, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def permuted(samples: DataFrame, reps: int, seed: int = 1, sample: str = "sample", value: str = "dosage") -> DataFrame:
    """``(rep, sample, value)`` for rep 1..reps: the values dealt anew to the samples.

    Samples are ordered once by themselves and once by a hash of (sample, rep,
    seed); the k-th sample gets the value of the k-th in hash order.
    """
    each = samples.select(sample, value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    key = F.md5(F.concat_ws(":", F.col(sample).cast("string"), F.col("rep").cast("string"), F.lit(str(seed))))
    plain = Window.partitionBy("rep").orderBy(sample)
    dealt = Window.partitionBy("rep").orderBy(key, sample)
    ranked = each.select("rep", sample, value, F.row_number().over(plain).alias("k"), F.row_number().over(dealt).alias("h"))
    return ranked.alias("a").join(ranked.alias("b"), (F.col("a.rep") == F.col("b.rep")) & (F.col("a.k") == F.col("b.h"))).select("a.rep", f"a.{sample}", f"b.{value}")


#: Rounds of a keyed permutation, the modulus of its keys, and the numbers that one task sends on, about.
PERMUTATION_ROUNDS, PERMUTATION_MODULUS, PERMUTED_ROWS = 48, (1 << 31) - 1, 200_000


def _mixed(x: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """A number below the modulus from two, by multiplications modulo a prime."""
    return ((((x * 16807 + key) % PERMUTATION_MODULUS) * 48271 + key) % PERMUTATION_MODULUS) * 69621 % PERMUTATION_MODULUS


def _permuted_numbers(number: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """All rounds for a batch of numbers at once."""
    known = (number.notna() & n.notna() & key.notna()).to_numpy()
    x, n, key = (s.to_numpy()[known].astype(np.int64) for s in (number, n, key))
    for r in range(PERMUTATION_ROUNDS):
        k = _mixed(key + r * 7919, r + 1) % n
        partner = (k - x + n) % n
        bit = (_mixed(np.maximum(x, partner), key + r * 104729) >> 11) & 1
        x = np.where(bit == 1, partner, x)
    return pd.Series(x, number.index[known], "Int64").reindex(number.index)


def keyed_permutation(number: Column, n: Column, key: Column) -> Column:
    """Where the permutation of 0..n-1 with some key (0 to 2^31 - 2) sends a number; a bijection for every n.

    Each round pairs x with (k - x) mod n, its partner in both directions, and a
    bit of the larger of the two decides for both whether they change places.
    """
    return F.pandas_udf(_permuted_numbers, "long")(*(c.cast("long") for c in (number, n, key)))


def permuted_by_key(samples: DataFrame, reps: int, seed: int = 1, sample: str = "sample", value: str = "dosage", number: str = "number") -> DataFrame:
    """``(rep, sample, value)`` as :func:`permuted` gives, by one lookup a row: no replicate is sorted.

    ``number`` counts the samples from 0 without gaps. Small tables come in few
    parts, so samples are dealt to as many tasks as their replicates need.
    """
    n = samples.count()
    each = samples.select(F.col(sample).alias("_s"), F.col(number).alias("_i")).repartition(max(1, -(-n * reps // PERMUTED_ROWS)))
    each = each.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    each = each.withColumn("_to", keyed_permutation(F.col("_i"), F.lit(max(n, 1)), (F.col("rep") + seed * 1_000_003) % PERMUTATION_MODULUS))
    values = samples.select(F.col(number).alias("_to"), value)
    return each.join(values, "_to").select("rep", F.col("_s").alias(sample), value)


def permutation_p(observed: DataFrame, null: DataFrame, by: tuple[str, ...] = ("bin",), score: str = "ratio") -> DataFrame:
    """``(*by, score, p)`` with p = (1 + permutations at or above) / (1 + permutations)."""
    drawn = null.select(*by, F.col(score).alias("_null"))
    joined = observed.join(drawn, list(by), "left").groupBy(*by, score).agg(F.count_if(F.col("_null") >= F.col(score)).alias("above"), F.count("_null").alias("reps"))
    return joined.select(*by, score, ((1 + F.col("above")) / (1 + F.col("reps"))).alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Add ``q``: the smallest m * p / rank at or above each p-value.

    p-values are counted by distinct value first, the counts are what the
    running sums see; equal p-values share the largest of their ranks. p-values
    of permutations have few distinct values. For continuous ones the running
    sums are cut into ranges of p.
    """
    counts = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_part", F.floor(-F.log10(F.greatest("_p", F.lit(1e-300))) * 64))
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_in_part"), F.lit(0).alias("_z"))
    before = F.coalesce(F.sum("_in_part").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_in_part").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("_part", before.alias("_before"), total.alias("_m"))
    ranked = counts.join(F.broadcast(parts), "_part")
    rank = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part").orderBy("_p"))
    ranked = ranked.withColumn("_raw", F.col("_m") * F.col("_p") / rank)
    lowest = ranked.groupBy("_part").agg(F.min("_raw").alias("_low"))
    after = F.min("_low").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    lowest = lowest.select("_part", after.alias("_after"))
    here = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc("_p")))
    q = ranked.join(F.broadcast(lowest), "_part").select("_p", F.least(here, F.coalesce("_after", F.lit(1.0)), F.lit(1.0)).alias("q"))
    return tests.join(q, tests[p] == q["_p"], "left").drop("_p")
