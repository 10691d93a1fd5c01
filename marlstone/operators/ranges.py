"""Long groups in ranges of their order, so that no task holds a whole group.

Groups of more than ``size`` rows are cut at approximate percentiles of the
order column; a range is a (group, ``_b``). What a window would carry over a
border comes from one summary row a range: a scan over the summaries, of which
a group has at most ``PARTS``, finds what lies before and behind each range, and
these rows join the range as guests. All other windows are local to a range.

Only long groups are looked at twice: counts tell which these are, and where
there are none nothing is cut. Rows of one position stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.folders import shared_folder

#: Rows of a group that one range holds, about, and ranges of one group.
ROWS, PARTS = 1_000_000, 2048
#: Borders that may be broadcast, 8 bytes each.
BROADCAST_CUTS = 2_000_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, stored, with a number from 0 up without gaps: its place in its part, behind the rows of the parts before."""
    kept = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.groupBy(part.alias("_p")).count().select("_p", before.alias("_before"))  # a row a part
    return kept.join(F.broadcast(starts), part == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_before")


def borders(rows: DataFrame, group: str, t: str, size: int = ROWS) -> tuple[DataFrame, int]:
    """``(_g, _cuts)`` of each group of more than ``size`` rows, and the number of all cuts."""
    parts = F.least(F.ceil(F.col("_n") / size), F.lit(PARTS)).cast("int")
    long = stored(rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > size).withColumn("_parts", parts))
    total = long.agg(F.sum("_parts")).first()[0] or 0
    if not total:
        return long.select("_g", F.lit(None).cast("array<double>").alias("_cuts")), 0
    hint = F.broadcast if total <= BROADCAST_CUTS else (lambda df: df)
    grid = F.percentile_approx(t, [k / PARTS for k in range(1, PARTS)], 20 * PARTS)
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda k: F.get("_grid", F.floor(k * PARTS / F.col("_parts")).cast("int") - 1)))
    found = rows.select(group, t).join(hint(long), F.col(group).eqNullSafe(F.col("_g"))).groupBy("_g").agg(grid.alias("_grid"), F.first("_parts").alias("_parts"))
    return stored(found.select("_g", chosen.alias("_cuts"))), total


def _number(cuts: Column, t: Column) -> Column:
    """How many cuts are at or below t, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(PARTS.bit_length()))))
    fits = lambda at, step: (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= t)
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at)), F.lit(0))


def cut(rows: DataFrame, group: str, t: str, size: int = ROWS) -> tuple[DataFrame, bool]:
    """``rows`` with their range ``_b`` (0 in short groups and for null positions), and whether any group is cut."""
    cuts, total = borders(rows, group, t, size)
    if not total:
        return rows.withColumn("_b", F.lit(0)), False
    joined = rows.join(F.broadcast(cuts) if total <= BROADCAST_CUTS else cuts, F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(_number(F.col("_cuts"), F.col(t)))).drop("_g", "_cuts"), True


def beside(rows: DataFrame, group: str, t: str, knot: str) -> DataFrame:
    """``(group, _b, _before, _after, _n)`` of each range: the last ``knot`` before it, the first behind it, and the knots before it.

    Rows whose ``knot`` is null are no knots.
    """
    place = F.when(F.col(knot).isNotNull(), F.col(t))
    ends = rows.groupBy(group, "_b").agg(F.max_by(knot, place).alias("_last"), F.min_by(knot, place).alias("_first"), F.count(knot).alias("_n"))
    up, down = (Window.partitionBy(group).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_b"), F.desc("_b")))
    return ends.select(group, "_b", F.last("_last", True).over(up).alias("_before"), F.last("_first", True).over(down).alias("_after"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n"))


def running(rows: DataFrame, group: str, t: str, sums: dict[str, Column], size: int = ROWS, order: list[str] | None = None) -> DataFrame:
    """``rows`` with running sums, each over its group up to and with its row, in the order of ``t`` (of ``order``, a finer order, where given)."""
    parts = rows.select("*", *(c.alias(f"_part_{name}") for name, c in sums.items()))
    parts, was_cut = cut(parts, group, t, size)
    own = parts.withColumn("_guest", F.lit(0))
    if was_cut:
        up = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        totals = parts.groupBy(group, "_b").agg(*(F.sum(f"_part_{name}").alias(f"_part_{name}") for name in sums))
        own = own.unionByName(totals.select(group, "_b", *(F.sum(f"_part_{name}").over(up).alias(f"_part_{name}") for name in sums), F.lit(1).alias("_guest")), allowMissingColumns=True)
    order = Window.partitionBy(group, "_b").orderBy(F.desc("_guest"), *(order or [t])).rowsBetween(Window.unboundedPreceding, 0)
    return own.select("*", *(F.sum(f"_part_{name}").over(order).alias(name) for name in sums)).where("_guest = 0").select(*rows.columns, *sums)
