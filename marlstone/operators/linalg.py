"""Matrices as tables of cells ``(i, j, v)``; absent cells are 0.

Products are equi-joins with partial sums. Factorisations of one small dense
matrix per group run in a grouped function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import ranges

CELLS = "i long, j long, v double"


def from_rows(df: DataFrame, row: str, values: str) -> DataFrame:
    """Cells of rows that hold an array each."""
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def constant(spark, height: int, width: int, v: float) -> DataFrame:
    return spark.range(height).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("j"), F.lit(float(v)).alias("v"))


def get(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.where((F.col("i") == i) & (F.col("j") == j)).select("v")


def put(m: DataFrame, i: int, j: int, v: float) -> DataFrame:
    return m.where(~((F.col("i") == i) & (F.col("j") == j))).unionByName(m.sparkSession.createDataFrame([(i, j, float(v))], CELLS))


def dims(m: DataFrame) -> DataFrame:
    return m.agg((F.coalesce(F.max("i"), F.lit(-1)) + 1).alias("height"), (F.coalesce(F.max("j"), F.lit(-1)) + 1).alias("width"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def rotate(m: DataFrame, height: int) -> DataFrame:
    """A quarter turn: cell (i, j) goes to (j, height - 1 - i)."""
    return m.select(F.col("j").alias("i"), (height - 1 - F.col("i")).alias("j"), "v")


def _both(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], how)


def multiply_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, "inner").select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def divide_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell; infinite or NaN where b is 0, and absent where both are."""
    from marlstone.functions.expr import ieee_divide

    zero = F.lit(0.0)
    return _both(a, b, "full").select("i", "j", ieee_divide(F.coalesce("x", zero), F.coalesce("y", zero)).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, scale(b, -1.0))


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * by)


def shift(m: DataFrame, by: float) -> DataFrame:
    """Add a constant to every cell of a table that holds all cells."""
    return m.withColumn("v", F.col("v") + by)


def scalar_minus(by: float, m: DataFrame) -> DataFrame:
    return m.withColumn("v", by - F.col("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    y = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


#: Inner indices of a narrow matrix, pairs of its rows that one task makes, about, and cells that may be broadcast.
NARROW, PAIRS, BROADCAST_CELLS = 64, 10_000_000, 4_000_000
#: Rows on the right side of a block of pairs: a file's page then holds each of them many times.
FLAT = 256


def gram_rows(a: DataFrame) -> DataFrame:
    """A A^T, a cell for every two rows that share an inner index.

    The result may have a cell for every pair of rows. Where A has few inner
    indices, each row becomes one with a column for each of them, so that every
    cell is made whole from two rows in one place: neither partial products nor
    cells are shuffled or summed, and a task holds no more than the broadcast rows.

    The rows are sorted by their values, and a task makes a block of many rows by
    ``FLAT``: i stays for a run, the same few j recur, and equal rows give equal
    cells side by side, so files of the result are a small part of its size.
    """
    a = ranges.stored(a.where("i is not null and j is not null"))
    inner = [r["j"] for r in a.select("j").distinct().limit(NARROW + 1).collect()]
    if not 0 < len(inner) <= NARROW:
        return matmul(a, transpose(a))
    names = range(len(inner))
    whole = a.groupBy("i").agg(*(F.sum(F.when(F.col("j") == j, F.col("v"))).alias(f"x{k}") for k, j in zip(names, inner, strict=True)))
    rows = ranges.stored(ranges.numbered(whole.orderBy(*(f"x{k}" for k in names), "i"), "_place"))
    n = rows.count()
    down, across = -(-n * min(n, FLAT) // PAIRS), -(-n // FLAT)
    left = rows.withColumn("_down", F.floor(F.col("_place") / -(-n // down)))
    right = rows.select("_place", F.floor(F.col("_place") / FLAT).alias("_across"), F.col("i").alias("j"), *(F.col(f"x{k}").alias(f"y{k}") for k in names))
    if n * (len(inner) + 1) <= BROADCAST_CELLS:
        blocks = a.sparkSession.range(0, down * across, 1, down * across).select(F.floor(F.col("id") / across).alias("_down"), (F.col("id") % across).alias("_across"))
        # generated code holds all that one row of its input yields: coalesce parts the joins, so that this is FLAT cells and not a block
        pairs = blocks.join(F.broadcast(left), "_down").coalesce(down * across).join(F.broadcast(right), "_across")
    else:
        pairs = left.repartitionByRange(down, "_place").crossJoin(right.repartitionByRange(across, "_place").hint("shuffle_replicate_nl"))
    met, v = F.lit(False), F.lit(0.0)
    for k in names:
        both = F.col(f"x{k}") * F.col(f"y{k}")
        met, v = met | both.isNotNull(), v + F.coalesce(both, F.lit(0.0))
    return pairs.where(met).select("i", "j", v.alias("v"))


def gram_columns(a: DataFrame) -> DataFrame:
    """A^T A."""
    return gram_rows(transpose(a))


def gram_of_arrays(df: DataFrame, values: str) -> DataFrame:
    """A^T A of rows that hold arrays of one width: each batch gives its own small product, Spark sums them."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf[values]])
                yield _cells(x.T @ x)

    return df.select(values).where(F.col(values).isNotNull()).mapInPandas(run, CELLS).groupBy("i", "j").agg(F.sum("v").alias("v"))


def covariance_of_arrays(df: DataFrame, values: str, by: str) -> DataFrame:
    """Sample covariances ``(by, i, j, v)`` of rows that hold arrays of one width, by group.

    Each batch gives the small product of each group's rows with a leading 1,
    so that number, sums and products are summed by Spark as one matrix.
    """

    def run(batches):
        for pdf in batches:
            for name, part in pdf.groupby(by, dropna=False):
                x = np.stack([np.asarray(v, float) for v in part[values]])
                cells = _cells((one := np.column_stack([np.ones(len(x)), x])).T @ one)
                yield cells.assign(**{by: part[by].iloc[0]})[[by, "i", "j", "v"]]

    kind = df.schema[by].dataType.simpleString()
    sums = df.select(by, values).where(F.col(values).isNotNull()).mapInPandas(run, f"{by} {kind}, {CELLS}").groupBy(by, "i", "j").agg(F.sum("v").alias("v"))
    over = lambda cell, *keys: F.max(F.when(cell, F.col("v"))).over(Window.partitionBy(by, *keys))
    first_i, first_j = F.col("i") == 0, F.col("j") == 0
    sums = sums.select("*", over(first_i & first_j).alias("n"), over(first_j, "i").alias("si"), over(first_i, "j").alias("sj"))
    return sums.where("i > 0 and j > 0").select(by, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), ((F.col("v") - F.col("si") * F.col("sj") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0))).alias("v"))


def lower(m: DataFrame) -> DataFrame:
    return m.where("i >= j")


def upper(m: DataFrame) -> DataFrame:
    return m.where("i <= j")


def frobenius(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of the products of the cells of two matrices; trace(A B) for symmetric ones."""
    return multiply_cells(a, b).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def norm_one(m: DataFrame) -> DataFrame:
    return m.agg(F.sum(F.abs("v")).alias("v"))


def covariance(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Sample covariances ``(*by, i, j, v)`` of some columns: one aggregation."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = df.groupBy(*by).agg(*(F.covar_samp(columns[i], columns[j]).alias(f"_{i}_{j}") for i, j in pairs))
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"_{min(i, j)}_{max(i, j)}").alias("v")) for i in range(n) for j in range(n)))
    return sums.select(*by, F.inline(cells))


def dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(max(pdf.i.max(), pdf.j.max())) + 1
    out = np.zeros((n, n))
    out[pdf.i, pdf.j] = pdf.v
    return out


def _per_matrix(m: DataFrame, name: str, solve, fields: str) -> DataFrame:
    kind = m.schema[name].dataType.simpleString()
    return m.groupBy(name).applyInPandas(lambda pdf: solve(pdf.assign(v=pdf.v.astype(float))).assign(**{name: pdf[name].iloc[0]})[[name, *(f.split()[0] for f in fields.split(", "))]], f"{name} {kind}, {fields}")


def _cells(a: np.ndarray, keep=lambda i, j: True) -> pd.DataFrame:
    n, w = a.shape
    rows = [(i, j, float(a[i, j])) for i in range(n) for j in range(w) if keep(i, j)]
    return pd.DataFrame(rows, columns=["i", "j", "v"])


def cholesky(m: DataFrame, name: str = "m") -> DataFrame:
    """``(m, i, j, v)``: the lower factor of each matrix; a matrix that is not positive definite has no rows."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return _cells(np.linalg.cholesky(dense(pdf)), lambda i, j: i >= j)
        except np.linalg.LinAlgError:
            return pd.DataFrame({"i": [], "j": [], "v": []})

    return _per_matrix(m, name, solve, "i long, j long, v double")


def inverse(m: DataFrame, name: str = "m") -> DataFrame:
    """``(m, i, j, v)``: the inverse (of a triangular matrix a triangular one); a singular matrix has no rows."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return _cells(np.linalg.inv(dense(pdf)))
        except np.linalg.LinAlgError:
            return pd.DataFrame({"i": [], "j": [], "v": []})

    return _per_matrix(m, name, solve, "i long, j long, v double")


def eigen(m: DataFrame, name: str = "m") -> DataFrame:
    """``(m, k, value, vector)`` of each symmetric matrix, ascending; the sign of a vector is free."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(dense(pdf))
        return pd.DataFrame({"k": range(len(values)), "value": values, "vector": list(vectors.T.tolist())})

    return _per_matrix(m, name, solve, "k long, value double, vector array<double>")


def log_determinant(factor: DataFrame, name: str = "m") -> DataFrame:
    """``(m, logdet)`` from a Cholesky factor."""
    return factor.where("i = j").groupBy(name).agg((2 * F.sum(F.log("v"))).alias("logdet"))


def condition_number(values: DataFrame, name: str = "m") -> DataFrame:
    """``(m, condition)``: largest over smallest eigenvalue."""
    return values.groupBy(name).agg((F.max("value") / F.nullif(F.min("value"), F.lit(0.0))).alias("condition"))


def tied_argmin(df: DataFrame, candidate: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The candidate with the smallest value; the mean of tied candidates."""
    best = df.groupBy(*by).agg(F.min(value).alias("_best")) if by else df.agg(F.min(value).alias("_best"))
    mean = F.avg(candidate).alias(candidate)
    if by:
        return df.join(best, list(by)).where(F.col(value) == F.col("_best")).groupBy(*by).agg(mean)
    lists = df.groupBy(value).agg(F.sum(candidate).alias("_s"), F.count(candidate).alias("_n"))
    return lists.agg(F.min_by(F.col("_s") / F.col("_n"), value).alias(candidate))
