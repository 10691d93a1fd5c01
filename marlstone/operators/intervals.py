"""Sliding bins over a coordinate, and segments of notable bins.

Bin k covers ``[low + k * spacing, low + k * spacing + size)`` for k from 0 to
``(high - low) // spacing - 1``. A range join is avoided: every position knows
the bins that cover it, so positions are first counted by cell (a stretch of
``spacing``) with partial aggregation and cells, not rows, are expanded.

Intervals meet intervals in a hierarchy of bins, in which each lies in at most
two bins of the level that suits its length (:func:`overlaps`). Where sums over
the pairs are wanted, no pairs are made (:func:`overlap_counts`, :func:`overlap_totals`).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import ranges


def _first_and_last(position: Column, low: int, high: int, spacing: int, size: int) -> tuple[Column, Column, Column]:
    """The first and the last bin that cover a position, and whether any does."""
    off = position - low
    last = F.least(F.floor(off / spacing), F.lit((high - low) // spacing - 1))
    first = F.greatest(F.floor((off - size) / spacing) + 1, F.lit(0))
    return first, last, (off >= 0) & (first <= last)


def covering_bins(position: Column, low: int, high: int, spacing: int, size: int) -> Column:
    """The numbers of the bins that cover a position, an array (empty outside the grid)."""
    first, last, some = _first_and_last(position, low, high, spacing, size)
    return F.when(some, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _cells(points: DataFrame, position: str, low: int, high: int, width: int, size: int, by: tuple[str, ...], weight: Column) -> DataFrame:
    cell = F.floor((F.col(position) - low) / width).alias("_cell")
    return points.where(F.col(position).between(low, high + size)).groupBy(*by, cell).agg(F.sum(weight).alias("n"))


def bin_counts(points: DataFrame, position: str, low: int, high: int, spacing: int, size: int, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """``(*by, bin, start, n)``: points in each sliding bin that has any.

    All positions of a cell, a stretch of the greatest common divisor of spacing
    and size, lie in the same bins. So points are summed by cell first, and what
    is expanded into size / spacing bins is one row for each cell and group.
    """
    weight = F.lit(1) if weight is None else weight
    width = gcd(spacing, size)
    cells = _cells(points, position, low, high, width, size, by, weight)
    spread = cells.select(*by, F.explode(covering_bins(low + F.col("_cell") * width, low, high, spacing, size)).alias("bin"), "n")
    return spread.groupBy(*by, "bin").agg(F.sum("n").alias("n")).select(*by, "bin", (low + F.col("bin") * spacing).alias("start"), "n")


def bin_steps(points: DataFrame, position: str, low: int, high: int, spacing: int, size: int, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """``(*by, bin, step)``: by how much the counts of :func:`bin_counts` change at a bin; a bin may have several rows, which add up.

    A cell is two rows, however many bins cover it.
    """
    width = gcd(spacing, size)
    cells = _cells(points, position, low, high, width, size, by, F.lit(1) if weight is None else weight)
    first, last, some = _first_and_last(low + F.col("_cell") * width, low, high, spacing, size)
    ends = F.array(F.struct(first.alias("bin"), F.col("n").alias("step")), F.struct((last + 1).alias("bin"), (-F.col("n")).alias("step")))
    return cells.where(some).select(*by, F.inline(ends)).where(F.col("bin") < (high - low) // spacing)


def bin_grid(spark, low: int, high: int, spacing: int) -> DataFrame:
    """All bins of a grid, ``(bin, start)``."""
    return spark.range((high - low) // spacing).select(F.col("id").alias("bin"), (low + F.col("id") * spacing).alias("start"))


def interval_ends(intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Both ends of every interval as positions."""
    keep = [c for c in intervals.columns if c not in (start, end)]
    return intervals.select(*keep, F.explode(F.array(start, end)).alias("position"))


#: Bins of one stretch, the part of a grid that one task merges.
STRETCH = 1_000_000


def segments(bins: DataFrame, spacing: int, by: tuple[str, ...] = (), start: str = "start", score: str | None = None, keep: dict[str, str] | None = None) -> DataFrame:
    """Merge adjacent bins: ``(*by, start, end, n[, ratio][, ...])``, ``n`` bins each, ``ratio`` the largest score.

    ``keep`` names further columns and how they are merged: max, min or sum. The
    grid is cut into stretches first and the islands that touch a stretch's
    border are joined to their neighbours, so no task holds all bins.
    """
    how = {**({"ratio": "max"} if score else {}), **(keep or {})}
    number = lambda c: F.floor(F.col(c) / spacing)
    cells = bins.select(*by, F.col(start).alias("start"), *([F.col(score).alias("ratio")] if score else []), *(keep or {}))
    cells = cells.withColumn("_stretch", F.floor(number("start") / STRETCH))
    island = number("start") - F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy("start"))
    merge = lambda n: [F.min("start").alias("start"), n, *(getattr(F, f)(c).alias(c) for c, f in how.items())]
    parts = cells.withColumn("_island", island).groupBy(*by, "_stretch", "_island").agg((F.max("start") + spacing).alias("end"), *merge(F.count("*").alias("n"))).drop("_stretch", "_island")
    at_border = (number("start") % STRETCH == 0) | (number("end") % STRETCH == 0)  # at most two islands a stretch
    chain = Window.partitionBy(*by).orderBy("start")
    linked = parts.where(at_border).withColumn("_new", F.coalesce((F.col("start") != F.lag("end").over(chain)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(chain))
    merged = linked.groupBy(*by, "_run").agg(F.max("end").alias("end"), *merge(F.sum("n").alias("n"))).drop("_run")
    out = [*by, "start", "end", "n", *how]
    return parts.where(~at_border).select(*out).unionByName(merged.select(*out))


#: Each level's bins are so many times as wide as those of the level below; 16 levels of 4 span lengths from 1 to 10^9 widths.
FANOUT, LEVELS = 4, 16


def _level(length: Column, width: float) -> Column:
    """The lowest level whose bins are at least as wide as an interval; the highest for all that are longer."""
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= width * FANOUT**k, F.lit(k)).otherwise(level)
    return level


def _bins(start: Column, end: Column, level: Column, width: float) -> Column:
    """The bins of a level that ``[start, end)`` touches."""
    wide = F.element_at(F.array(*(F.lit(float(width * FANOUT**k)) for k in range(LEVELS))), level + 1)
    first = F.floor(start / wide)
    return F.sequence(first, F.greatest(first, F.ceil(end / wide) - 1))


def overlaps(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of rows of ``a`` and ``b`` that are equal in ``by`` and whose intervals ``[start, end)`` overlap.

    An interval's own level is the lowest whose bins are as wide as the interval,
    where it lies in one or two bins. A pair meets at the higher of its two
    levels: there the longer interval is in its own bins, and the shorter one in
    the bins above its own. So every interval is expanded once for each level
    that the other table has at or above its own (for ``a``: above), in one or
    two bins. Of the bins that a pair shares only the one with the later of the
    two starts emits it, so no pair comes twice and none is deduplicated.

    ``width`` is the bin width of the lowest level, about the usual length of
    short intervals; results do not depend on it. Columns of both tables are
    kept (those of ``by`` once), other names must differ. Null ends, empty
    intervals and null keys have no pairs.
    """
    def own(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = F.col(span[0]), F.col(span[1])
        return df.where(start < end).withColumn(f"_{name}", _level(end - start, width))

    def lifted(df: DataFrame, span: tuple[str, str], name: str, levels: list[int], strict: bool) -> DataFrame:
        fits = lambda k: F.col(f"_{name}") < k if strict else F.col(f"_{name}") <= k
        up = df.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), fits)))
        return up.withColumn("_bin", F.explode(_bins(F.col(span[0]), F.col(span[1]), F.col("_level"), width)))

    a, b = own(a, a_span, "la"), own(b, b_span, "lb")
    levels = lambda df, name: sorted(r[0] for r in df.select(name).distinct().collect())  # no more than LEVELS
    in_a, in_b = levels(a, "_la"), levels(b, "_lb")
    begin = F.greatest(a_span[0], b_span[0])
    meets = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1]))
    names = [*by, *(c for c in a.columns if c not in by and c != "_la"), *(c for c in b.columns if c not in by and c != "_lb")]

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        first = _bins(begin, begin, F.col("_level"), width)[0]
        return x.join(y, [*by, "_level", "_bin"]).where(meets & (F.col("_bin") == first)).select(*names)

    at_home = lambda df, span, name: lifted(df.withColumn("_here", F.col(f"_{name}")), span, name, list(range(LEVELS)), False).where("_level = _here").drop("_here")
    shorter_b = met(at_home(a, a_span, "la"), lifted(b, b_span, "lb", in_a, False))
    shorter_a = met(lifted(a, a_span, "la", in_b, True), at_home(b, b_span, "lb"))
    return shorter_b.unionByName(shorter_a)


def _valid(span: tuple[str, str], keys: tuple[str, ...]) -> Column:
    """Whether an interval is not empty and no key of it is null."""
    ok = F.col(span[0]) < F.col(span[1])
    for k in keys:
        ok &= F.col(k).isNotNull()
    return ok


def _ends(b: DataFrame, span: tuple[str, str], keys: tuple[str, ...], length: bool) -> DataFrame:
    """``(*keys, _t, _rank, _begun, _ended, _edge)``: how many intervals start and end at each position, a row for each that has any; stored."""
    edge = lambda c, sign: (F.col(c) * sign if length else F.lit(0)).alias("edge")
    end = lambda c, rank, begun, ended, sign: F.struct(F.col(c).alias("t"), F.lit(rank).alias("rank"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"), edge(c, sign))
    # at one position: ends count before what is asked there, starts after it
    both = b.select(*keys, F.explode(F.array(end(span[1], 0, 0, 1, 1), end(span[0], 2, 1, 0, -1))).alias("_e"))
    return ranges.stored(both.groupBy(*keys, F.col("_e.t").alias("_t"), F.col("_e.rank").alias("_rank")).agg(*(F.sum(f"_e.{c}").alias(f"_{c}") for c in ("begun", "ended", "edge"))))


def _counted_at(asked: DataFrame, ends: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """``asked`` (*keys, _t) with the sums of ``_ends`` there: starts before the position, ends at or before it."""
    order = F.struct("_t", "_rank").alias("_o")
    group = F.struct(F.lit(0).alias("_"), *keys).alias("_grp")
    none = F.lit(0).cast("long")
    rows = ends.unionByName(asked.select(*keys, "_t", F.lit(1).alias("_rank"), *(none.alias(c) for c in ("_begun", "_ended", "_edge"))))
    rows = ranges.stored(rows.select("*", group, order, F.col("_t").cast("double").alias("_d")))
    counted = ranges.running(rows, "_grp", "_d", {c: F.col(f"_{c}") for c in ("begun", "ended", "edge")}, size, order=["_o"])
    return counted.where("_rank = 1").select(*keys, "_t", "begun", "ended", "edge")


def overlap_counts(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], group: str, size: int = ranges.ROWS) -> DataFrame:
    """``a`` with ``n``, the number of rows of ``b`` of its group that overlap ``[start, end)``, without making pairs.

    Those are the ones that start before the end, less those that end at or
    before the start; both are running counts over all ends in order, in ranges
    where a group is long. The counts run over distinct positions, from which
    every row looks its two numbers up. Null ends, null groups and empty
    intervals count 0.
    """
    keys = (group,)
    asked = a.where(_valid(a_span, keys)).select(group, F.explode(F.array(*a_span)).alias("_t")).distinct()
    at = ranges.stored(_counted_at(asked, _ends(b.where(_valid(b_span, keys)), b_span, keys, False), keys, size))
    found = a
    for k, (c, what) in enumerate(zip(a_span, ("ended", "begun"), strict=True)):
        side = at.select(F.col(group).alias(f"_g{k}"), F.col("_t").alias(f"_t{k}"), F.col(what).alias(f"_{what}"))
        found = found.join(side, (F.col(group) == F.col(f"_g{k}")) & (F.col(c) == F.col(f"_t{k}")), "left")
    n = F.when(_valid(a_span, keys), F.col("_begun") - F.col("_ended"))
    return found.select(*a.columns, F.coalesce(n, F.lit(0)).alias("n"))


def overlap_totals(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], by: tuple[str, ...] = (), a_by: tuple[str, ...] = (), b_by: tuple[str, ...] = (), size: int = ranges.ROWS) -> DataFrame:
    """``(*by, *a_by, *b_by, n, length)``: the pairs that :func:`overlaps` has, and the length that both last, summed, without making pairs.

    What intervals of ``b`` cover before a position t, each counted, is
    ``t * (begun - ended)``, less their starts, plus the ends that have passed;
    its growth over an interval of ``a`` is the length of all its overlaps. So
    both sums need running sums at the ends of ``a`` only, of which equal ones
    are counted first. Work is one row for each position of an end, times the
    groups ``b_by`` for those of ``a``. Groups without pairs have no row; whole
    positions give exact results.
    """
    end = lambda c, starts, ends: F.struct(F.col(c).alias("t"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))
    asks = a.where(_valid(a_span, by)).select(*by, *a_by, F.explode(F.array(end(a_span[0], 1, 0), end(a_span[1], 0, 1))).alias("_e"))
    asks = ranges.stored(asks.groupBy(*by, *a_by, F.col("_e.t").alias("_t")).agg(F.sum("_e.starts").alias("_starts"), F.sum("_e.ends").alias("_ends")))
    keys = (*by, *b_by)
    ends = _ends(b.where(_valid(b_span, by)), b_span, keys, True)
    asked = asks.select(*by, "_t").distinct()
    if b_by:
        kinds = ends.select(*keys).distinct()
        asked = asked.join(kinds, [*by]) if by else asked.crossJoin(kinds)
    met = asks.join(_counted_at(asked, ends, keys, size), [*by, "_t"])
    covered = F.col("_t") * (F.col("begun") - F.col("ended")) + F.col("edge")
    n = F.sum(F.col("_ends") * F.col("begun") - F.col("_starts") * F.col("ended"))
    return met.groupBy(*by, *a_by, *b_by).agg(n.alias("n"), F.sum((F.col("_ends") - F.col("_starts")) * covered).alias("length")).where("n > 0")
