"""Matrices in dense tiles ``(bi, bj, v)``, ``v`` the row-major doubles of a tile; absent tiles are 0.

A product joins super-blocks of tiles, not cells: the tiles of a few rows of the
one factor meet those of a few columns of the other, for a stretch of the inner
index, in one task that makes one dense product for each pair. Partial tiles
are summed in groups of bounded size. A hot inner index is spread over all
super-blocks, and of a symmetric or triangular result only half is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import linalg, ranges

TILE = "bi long, bj long, v binary"
#: Tiles of a side of a super-block, and partial tiles that are summed at once.
SIDE, SUMMED = 8, 64


@dataclass(frozen=True)
class Tiles:
    """``df`` with the matrix's height and width and those of a tile (less at the lower and right border)."""

    df: DataFrame
    height: int
    width: int
    rows: int
    cols: int

    def tile(self, bi: int, bj: int, v: bytes) -> np.ndarray:
        return np.frombuffer(v).reshape(min(self.rows, self.height - bi * self.rows), min(self.cols, self.width - bj * self.cols))

    def down(self) -> int:
        return -(-self.height // self.rows)

    def across(self) -> int:
        return -(-self.width // self.cols)


def _tile_table(tiles: dict[tuple[int, int], np.ndarray]) -> pa.Table:
    return pa.table({"bi": pa.array([k[0] for k in tiles], pa.int64()), "bj": pa.array([k[1] for k in tiles], pa.int64()), "v": pa.array([np.ascontiguousarray(v, float).tobytes() for v in tiles.values()], pa.binary())})


def from_cells(cells: DataFrame, rows: int = 256, cols: int = 256, shape: tuple[int, int] | None = None) -> Tiles:
    """Tiles of cells (i, j, v) from 0 up; without ``shape`` the largest indices are looked up. Cells given twice add up."""
    height, width = shape or linalg.dims(cells).first()
    out = Tiles(cells, height, width, rows, cols)

    def dense(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        v = np.zeros((min(rows, height - bi * rows), min(cols, width - bj * cols)))
        i, j = group["i"].to_numpy() - bi * rows, group["j"].to_numpy() - bj * cols
        np.add.at(v, (i, j), group["v"].to_numpy())
        return _tile_table({(bi, bj): v})

    placed = cells.select(F.floor(F.col("i") / rows).alias("bi"), F.floor(F.col("j") / cols).alias("bj"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return replace(out, df=placed.groupBy("bi", "bj").applyInArrow(dense, TILE))


def cells_of(tiles: Tiles, transposed_too: bool = False) -> Callable[[int, int, np.ndarray], pa.Table]:
    """A ``finish`` of :func:`product` that gives the cells (i, j, v) of each tile, of a symmetric half also the mirrored ones."""
    rows, cols = tiles.rows, tiles.cols

    def finish(bi: int, bj: int, v: np.ndarray) -> pa.Table:
        i, j = (x.ravel() for x in np.indices(v.shape))
        table = pa.table({"i": i + bi * rows, "j": j + bj * cols, "v": v.ravel()})
        if transposed_too and bi != bj:
            table = pa.concat_tables([table, pa.table({"i": table["j"], "j": table["i"], "v": table["v"]})])
        return table

    return finish


def product(a: Tiles, b: Tiles, part: str = "all", b_transposed: bool = False, finish: Callable[[int, int, np.ndarray], pa.Table] | None = None, ddl: str = TILE) -> Tiles | DataFrame:
    """A B (with ``b_transposed`` A B^T); ``part`` ``lower`` makes only tiles that touch the lower triangle.

    ``finish(bi, bj, tile)`` turns each finished tile into rows of ``ddl``, which
    are returned instead of tiles: cells, sums or what else is wanted, without
    moving the tiles again.
    """
    inner, cols, width = (b.width, b.rows, b.height) if b_transposed else (b.height, b.cols, b.width)
    step = b.cols if b_transposed else b.rows
    if a.width != inner or a.cols != step:
        raise ValueError("the factors' inner sizes differ")
    out = Tiles(a.df, a.height, width, a.rows, cols)
    rows, whole = out.rows, part != "lower"
    wanted = lambda bi, bj: whole or (bi + 1) * rows > bj * cols
    k_groups = -(-a.across() // SIDE)
    down, across = -(-out.down() // SIDE), -(-out.across() // SIDE)
    k_a, k_b, bj_b = "bj", *(("bj", "bi") if b_transposed else ("bi", "bj"))
    group = lambda c: F.floor(F.col(c) / SIDE).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = a.df.select(group("bi").alias("gi"), group(k_a).alias("gk"), "bi", F.col(k_a).alias("k"), "v").select("*", every(max(across, 1)).alias("gj"))
    right = b.df.select(group(bj_b).alias("gj"), group(k_b).alias("gk"), F.col(bj_b).alias("column"), F.col(k_b).alias("k"), F.col("v").alias("w")).select("*", every(max(down, 1)).alias("gi"))  # other names than the left side's, which may be the same table
    if part == "lower":
        left, right = (x.where((F.col("gi") + 1) * SIDE * out.rows > F.col("gj") * SIDE * out.cols) for x in (left, right))
    done = k_groups <= 1 and finish is not None

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:  # absent tiles are 0
            return _empty(ddl if done else f"{TILE}, gk long")
        right_of: dict[int, list] = {}
        for r in y.select(["column", "k", "w"]).to_pylist():
            v = b.tile(r["column"], r["k"], r["w"]).T if b_transposed else b.tile(r["k"], r["column"], r["w"])
            right_of.setdefault(r["k"], []).append((r["column"], v))
        sums: dict[tuple[int, int], np.ndarray] = {}
        for r in x.select(["bi", "k", "v"]).to_pylist():
            v = a.tile(r["bi"], r["k"], r["v"])
            for bj, w in right_of.get(r["k"], []):
                if wanted(r["bi"], bj):
                    sums[r["bi"], bj] = sums[r["bi"], bj] + v @ w if (r["bi"], bj) in sums else v @ w
        if done:
            tables = [finish(*key, v) for key, v in sums.items()]
            return pa.concat_tables(tables) if tables else _empty(ddl)
        return _tile_table(sums).append_column("gk", pa.array([x["gk"][0].as_py()] * len(sums), pa.int64()))

    keys = ["gi", "gj", "gk"]
    a, b = replace(a, df=None), replace(b, df=None)  # the tasks need their shapes only
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, ddl if done else f"{TILE}, gk long")
    if done:
        return partial
    while k_groups > SUMMED:
        k_groups = -(-k_groups // SUMMED)
        partial = partial.withColumn("gk", F.floor(F.col("gk") / SUMMED)).groupBy("bi", "bj", "gk").applyInArrow(_summed(replace(out, df=None), True), f"{TILE}, gk long")
    if finish is None and k_groups <= 1:
        return replace(out, df=partial.drop("gk"))
    summed = partial.groupBy("bi", "bj").applyInArrow(_summed(replace(out, df=None), False, finish), ddl)
    return replace(out, df=summed) if finish is None else summed


def _empty(ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))})


def _summed(shape: Tiles, keep_group: bool, finish: Callable | None = None) -> Callable[[pa.Table], pa.Table]:
    """The sum of a tile's parts."""

    def run(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        total = sum(shape.tile(bi, bj, v) for v in group["v"].to_pylist())
        if finish is not None:
            return finish(bi, bj, total)
        out = _tile_table({(bi, bj): total})
        return out.append_column("gk", pa.array([group["gk"][0].as_py()], pa.int64())) if keep_group else out

    return run


def matmul(a: DataFrame, b: DataFrame, rows: int = 256, cols: int = 256) -> DataFrame:
    """The cells of A B for cells of both (all cells of tiles that have any)."""
    x = from_cells(a, rows, cols)
    y = from_cells(b, cols, rows)
    if x.width != y.height:  # trailing rows or columns without cells
        n = max(x.width, y.height)
        x, y = from_cells(a, rows, cols, (x.height, n)), from_cells(b, cols, rows, (n, y.width))
    return product(x, y, finish=cells_of(Tiles(None, x.height, y.width, rows, rows)), ddl="i long, j long, v double")


def gram_rows(a: Tiles, finish: Callable[[int, int, np.ndarray], pa.Table] | None = None, ddl: str = "i long, j long, v double") -> DataFrame:
    """A A^T from its lower half; by default all its cells, otherwise what ``finish`` makes of the lower half's tiles."""
    half = replace(a, df=None, width=a.height, cols=a.rows)
    return product(a, a, "lower", True, finish or cells_of(half, True), ddl)


def row_summary(tiles: Tiles) -> Callable[[int, int, np.ndarray], pa.Table]:
    """A ``finish`` for :func:`gram_rows`: sum and largest cell of every row of a tile, and of the mirrored tile's rows."""
    rows = tiles.rows

    def finish(bi: int, bj: int, v: np.ndarray) -> pa.Table:
        sides = [(bi, v)] + ([(bj, v.T)] if bi != bj else [])
        return pa.concat_tables([pa.table({"i": np.arange(len(m), dtype=np.int64) + b * rows, "total": m.sum(1), "largest": m.max(1)}) for b, m in sides])

    return finish


def gram_summary(cells: DataFrame, rows: int = 256, cols: int = 256) -> DataFrame:
    """``(i, total, largest)``: sum and largest cell of the row of A A^T of every i that has cells (i, j, v) in A.

    Equal rows of A have equal rows in A A^T, so each distinct row is multiplied
    once, and the sums, being linear, come from the sums of A's columns. The work
    is one pass over the cells and the square of the number of distinct rows.
    """
    cell = F.when(F.col("v") != 0, F.struct(F.col("j").cast("long").alias("j"), "v"))
    known = cells.where("i is not null and j is not null").repartition("i").groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    every = ranges.stored(known.groupBy("i").agg(F.sort_array(F.collect_list(cell)).alias("row")))
    distinct = ranges.stored(ranges.numbered(every.groupBy("row").agg(F.count("*").alias("_n")), "d"))
    zero = F.array(F.struct(F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v")))  # rows of zeros are rows too
    kept = ranges.stored(distinct.select(F.col("d").alias("i"), "_n", F.inline(F.when(F.size("row") == 0, zero).otherwise(F.col("row")))))
    height, width = distinct.count(), linalg.dims(kept).first()["width"]
    sums = kept.groupBy("j").agg(F.sum(F.col("_n") * F.col("v")).alias("_sum"))
    total = kept.join(sums, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_sum")).alias("total"))

    def finish(bi: int, bj: int, v: np.ndarray) -> pa.Table:
        sides = [(bi, v)] + ([(bj, v.T)] if bi != bj else [])
        return pa.concat_tables([pa.table({"i": np.arange(len(m), dtype=np.int64) + b * rows, "seen": np.full(len(m), m.shape[1]), "largest": m.max(1)}) for b, m in sides])

    made = gram_rows(from_cells(kept, rows, cols, (height, width)), finish, "i long, seen long, largest double").groupBy("i").agg(F.sum("seen").alias("_seen"), F.max("largest").alias("_most"))
    largest = F.when(F.col("_seen") < height, F.greatest("_most", F.lit(0.0))).otherwise(F.col("_most"))  # tiles that were not made are 0
    found = ranges.stored(distinct.join(total, F.col("d") == total["i"]).drop("i").join(made, F.col("d") == made["i"]).select("row", "total", largest.alias("largest")))
    return every.join(found, "row").select("i", "total", "largest")
