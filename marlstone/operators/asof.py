"""As-of brackets: the knots around each query position, without a range join.

Knots and queries are put in one order and a window carries the last knot at or
before, and the first knot after, each query. Long groups are cut into ranges
(:mod:`marlstone.operators.ranges`, by ``size`` rows) or, with ``bucket``, into
stretches of one width of the position; a range also gets the last knot before
it and the first one behind it, so no window runs over a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import ranges


def with_neighbours(knots: DataFrame, group: str = "grp", t: str = "t", values: tuple[str, ...] = ("y",), size: int | None = None) -> DataFrame:
    """Add ``_k``: a struct of the knot (t, values), the next one (t_n, ..) and the previous one (t_p, ..), and of the knot's number ``i``."""
    names = list(zip((t, *values), ("t", *values), strict=True))
    rows, was_cut = ranges.cut(knots, group, t, size) if size else (knots.withColumn("_b", F.lit(0)), False)
    rows = rows.select("*", F.struct(*(F.col(c).cast("double").alias(n) for c, n in names)).alias("_own"), F.lit(1).alias("_side"), F.lit(1).cast("long").alias("_n"))
    if was_cut:
        near = ranges.beside(rows, group, t, "_own")
        guests = near.select(group, "_b", F.inline(F.array(F.struct(F.col("_before").alias("_own"), F.lit(0).alias("_side"), F.col("_n")), F.struct(F.col("_after").alias("_own"), F.lit(2).alias("_side"), F.lit(0).cast("long").alias("_n")))))
        rows = rows.unionByName(guests.where("_own is not null"), allowMissingColumns=True)
    order = Window.partitionBy(group, "_b").orderBy("_side", "_own.t")
    fields = [F.col(f"_own.{n}").alias(n) for _, n in names]
    fields += [f(f"_own.{n}").over(order).alias(f"{n}_{s}") for s, f in (("n", F.lead), ("p", F.lag)) for _, n in names]
    number = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.select("*", F.struct(*fields, number.cast("int").alias("i")).alias("_k")).where("_side = 1").select(*knots.columns, "_k")


def bracket(knots: DataFrame, queries: DataFrame, group: str = "grp", t: str = "t", values: tuple[str, ...] = ("y",), bucket: float | None = None, size: int | None = None) -> DataFrame:
    """The columns of ``queries`` with ``lo`` and ``hi``, the knots (structs of t and values) of the interval that serves the query.

    An interval starts at its knot; below the first knot the first interval
    serves, at and above the last knot the last one. A group of one knot has
    it on both sides, a group without knots gives nulls. ``lo.i`` counts the
    interval from 0.
    """
    full = with_neighbours(knots.select(group, t, *values), group, t, values, size)
    q = queries.withColumn("_q", F.struct(*queries.columns))
    rows = full.select(group, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_side"), "_k", F.lit(None).cast(q.schema["_q"].dataType).alias("_q"))
    rows = rows.unionByName(q.select(group, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(full.schema["_k"].dataType).alias("_k"), "_q"))
    if size and not bucket:
        rows, was_cut = ranges.cut(rows, group, "_t", size)
    else:
        rows, was_cut = rows.withColumn("_b", F.floor(F.col("_t") / bucket) if bucket else F.lit(0).cast("long")), bool(bucket)
    if was_cut:
        near = ranges.beside(rows, group, "_t", "_k").select(group, "_b", F.explode(F.array("_before", "_after")).alias("_k")).where("_k is not null")
        rows = rows.unionByName(near.select(group, F.col("_k.t").alias("_t"), F.lit(0).alias("_side"), "_k", F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), "_b"))
    order = Window.partitionBy(group, "_b").orderBy("_t", "_side")
    found = rows.withColumn("_at", F.last("_k", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # before the first knot the first one serves: one value for the whole range
    found = found.withColumn("_next", F.first("_k", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("_q is not null")
    names = ("t", *values)
    own = lambda k, i: F.struct(*(F.col(f"{k}.{n}").alias(n) for n in names), (F.col(f"{k}.i") + i).alias("i"))
    side = lambda k, s, i: F.struct(*(F.col(f"{k}.{n}_{s}").alias(n) for n in names), (F.col(f"{k}.i") + i).alias("i"))
    at, nxt = F.col("_at"), F.col("_next")
    lo = F.when(at.isNull(), F.when(nxt.isNotNull(), own("_next", 0))).when(F.col("_at.t_n").isNull() & F.col("_at.t_p").isNotNull(), side("_at", "p", -1)).otherwise(own("_at", 0))
    hi = F.when(at.isNull(), F.when(F.col("_next.t_n").isNotNull(), side("_next", "n", 1)).otherwise(F.when(nxt.isNotNull(), own("_next", 0)))).when(F.col("_at.t_n").isNull(), own("_at", 0)).otherwise(side("_at", "n", 1))
    return found.select("_q.*", lo.alias("lo"), hi.alias("hi"))


def _ranged(rows: DataFrame, group: str, size: int | None) -> DataFrame:
    """Knots and queries (group, _t, _side, _k, _q) in ranges, each with the knots beside it (``_side`` -1 before, 2 behind)."""
    rows, was_cut = ranges.cut(rows, group, "_t", size) if size else (rows.withColumn("_b", F.lit(0)), False)
    if not was_cut:
        return rows
    near = ranges.beside(rows, group, "_t", "_k")
    guests = near.select(group, "_b", F.inline(F.array(*(F.struct(F.col(c).alias("_k"), F.lit(side).alias("_side")) for c, side in (("_before", -1), ("_after", 2))))))
    return rows.unionByName(guests.where("_k is not null"), allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, group: str, t: str, values: tuple[str, ...], size: int | None = ranges.ROWS) -> DataFrame:
    """``left`` with ``t_right`` and the values of the last row of ``right`` at or before it (null where there is none)."""
    q = left.withColumn("_q", F.struct(*left.columns))
    k = F.struct(F.col(t), *(F.col(v) for v in values))
    rows = right.select(group, F.col(t).alias("_t"), F.lit(0).alias("_side"), k.alias("_k"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"))
    kind = rows.schema["_k"].dataType
    rows = rows.unionByName(q.select(group, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_k"), "_q"))
    rows = _ranged(rows, group, size).where("_side < 2")
    order = Window.partitionBy(group, "_b").orderBy(F.col("_side") >= 0, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_at", F.last("_k", True).over(order)).where("_q is not null")
    return found.select("_q.*", F.col(f"_at.{t}").alias(f"{t}_right"), *(F.col(f"_at.{v}").alias(v) for v in values))


def step_value(knots: DataFrame, queries: DataFrame, group: str = "grp", t: str = "t", y: str = "y", size: int | None = ranges.ROWS) -> DataFrame:
    """``queries`` with ``value``: y of the first knot at or after the position, else of the last knot."""
    q = queries.withColumn("_q", F.struct(*queries.columns))
    rows = knots.select(group, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(F.col(y).cast("double").alias("y")).alias("_k"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"))
    kind = rows.schema["_k"].dataType
    rows = rows.unionByName(q.select(group, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_k"), "_q"))
    rows = _ranged(rows, group, size)
    # both windows run from their end to the row, so that each is one pass over the range
    place = F.when(F.col("_side") == -1, 0).when(F.col("_side") == 2, 2).otherwise(1)
    down = Window.partitionBy(group, "_b").orderBy(F.desc(place), F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(group, "_b").orderBy(place, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = F.coalesce(F.last("_k", True).over(down), F.last("_k", True).over(up))
    return rows.withColumn("_at", here).where("_q is not null").select("_q.*", F.col("_at.y").alias("value"))
