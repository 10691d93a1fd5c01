"""Long groups in ranges, intervals in hierarchical bins, matrices in tiles and systems in blocks, against slow versions."""

import bisect
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import asof, banded, interp, intervals, linalg, ranges, tiles


def test_a_group_in_two_hundred_tasks(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([("all" if k % 9 else None, rnd.gauss(0, 1) ** 3) for k in range(40_000)], "grp string, t double").repartition(3)
    got, was_cut = ranges.cut(rows, "grp", "t", size=200)
    sizes = sorted(r["count"] for r in got.where("grp = 'all'").groupBy("_b").count().collect())
    assert was_cut and len(sizes) > 170 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    ends = got.where("grp is null").groupBy("_b").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_b").collect()
    assert len(ends) > 15 and all(x["b"] < y["a"] for x, y in zip(ends, ends[1:], strict=False))
    assert not ranges.cut(rows, "grp", "t", size=40_000)[1] and not ranges.cut(rows.limit(0), "grp", "t")[1]


@pytest.fixture(scope="module")
def scattered(spark):
    """Two groups, one long; knots with a quarter of the positions of the queries, ties between both."""
    rnd = random.Random(5)
    knots = [(g, float(t), rnd.random()) for g, n in (("long", 900), ("short", 7)) for t in rnd.sample(range(4 * n), n)]
    asked = [(g, float(rnd.randrange(-9, 4 * n + 9))) for g, n in (("long", 1500), ("short", 9)) for _ in range(n)] + [("none", 1.0), ("long", None)]
    return knots, asked, spark.createDataFrame(knots, "grp string, t double, y double").repartition(3), spark.createDataFrame(asked, "grp string, t double").repartition(3)


@pytest.mark.parametrize("size", [None, 40, 100_000])
def test_lookups_in_ranges(scattered, size):
    knots, asked, k, q = scattered
    by = {g: sorted((t, y) for h, t, y in knots if h == g) for g in ("long", "short", "none")}
    value = lambda r: (r["grp"], r["t"])
    before, step, between = {}, {}, {}
    for g, t in asked:
        if t is None:
            continue
        ts = [x for x, _ in by[g]]
        i = bisect.bisect_right(ts, t)
        before[g, t] = by[g][i - 1] if i else (None, None)
        j = bisect.bisect_left(ts, t)
        step[g, t] = by[g][min(j, len(ts) - 1)][1] if ts else None
        a = max(1, min(len(ts) - 1, i)) if ts else 0
        between[g, t] = (by[g][a - 1][0], by[g][a][0], a - 1) if ts else None
    got = asof.asof(q, k.withColumn("last", F.col("y")), "grp", "t", ("last",), size=size).where("t is not null").collect()
    assert len(got) == len(asked) - 1 and all((r["t_right"], r["last"]) == before[value(r)] for r in got)
    got = asof.step_value(k, q, size=size).where("t is not null").collect()
    assert len(got) == len(asked) - 1 and all(r["value"] == step[value(r)] for r in got)
    got = asof.bracket(k, q, size=size).where("t is not null").collect()
    assert len(got) == len(asked) - 1
    assert all((r["lo"] and (r["lo"]["t"], r["hi"]["t"], r["lo"]["i"])) == between[value(r)] for r in got)


def test_running_sums_and_areas_in_ranges(scattered):
    knots, _, k, _ = scattered
    got = {(r["grp"], r["t"]): (r["s"], r["n"]) for r in ranges.running(k, "grp", "t", {"s": F.col("y"), "n": F.lit(1)}, size=50).collect()}
    area = {}
    for g in ("long", "short"):
        rows = sorted((t, y) for h, t, y in knots if h == g)
        for i, (t, _) in enumerate(rows):
            assert got[g, t][1] == i + 1 and abs(got[g, t][0] - sum(y for _, y in rows[: i + 1])) < 1e-9
        area[g] = np.trapezoid([y for _, y in rows], [t for t, _ in rows])
    limits = k.groupBy("grp").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    whole = {r["grp"]: r["integral"] for r in interp.linear_integral(k, limits, size=60).collect()}
    assert whole == pytest.approx(area)


def test_overlaps(spark):
    rnd = random.Random(9)
    span = lambda: (s := rnd.randrange(-50, 400), s + int(rnd.choice([0, 1, 2, 5, 20, 90, 700]) * rnd.random()))
    a = [(k, rnd.choice("xy"), *span()) for k in range(150)] + [(900, "x", None, 3), (901, None, 0, 500), (902, "x", 5, 4)]
    b = [(k, rnd.choice("xyz"), *span()) for k in range(200)] + [(900, "x", 3, None), (901, None, 0, 500)]
    ta = spark.createDataFrame(a, "i long, g string, a0 long, a1 long").repartition(3)
    tb = spark.createDataFrame(b, "j long, g string, b0 long, b1 long").repartition(3)
    ok = lambda x: x[1] is not None and None not in x[2:] and x[2] < x[3]
    want = Counter((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    for width in (1, 8, 0.5, 1000):
        got = intervals.overlaps(ta, tb, ("a0", "a1"), ("b0", "b1"), width=width, by=("g",))
        assert got.columns == ["g", "i", "a0", "a1", "j", "b0", "b1"]
        assert Counter((r["i"], r["j"]) for r in got.collect()) == want, width
    everywhere = Counter((x[0], y[0]) for x in a for y in b if None not in (*x[2:], *y[2:]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert Counter((r["i"], r["j"]) for r in intervals.overlaps(ta.drop("g"), tb.drop("g"), ("a0", "a1"), ("b0", "b1"), width=4).collect()) == everywhere
    for size in (30, 10**6):
        counts = {r["i"]: r["n"] for r in intervals.overlap_counts(ta, tb, ("a0", "a1"), ("b0", "b1"), "g", size=size).where("g is not null").collect()}
        assert counts == {x[0]: sum(n for (i, _), n in want.items() if i == x[0]) for x in a if x[1] is not None}
    assert intervals.overlaps(ta.limit(0), tb, ("a0", "a1"), ("b0", "b1"), width=4, by=("g",)).count() == 0
    far = spark.createDataFrame([(1, 0, 10**15)], "i long, a0 long, a1 long")
    near = spark.createDataFrame([(2, 10**15 - 1, 10**15), (3, 10**15, 10**15 + 1)], "j long, b0 long, b1 long")
    assert [r["j"] for r in intervals.overlaps(far, near, ("a0", "a1"), ("b0", "b1"), width=1).collect()] == [2]


def test_overlaps_summed_without_pairs(spark):
    rnd = random.Random(10)
    span = lambda: (s := rnd.randrange(-50, 400), s + int(rnd.choice([0, 1, 2, 5, 20, 90, 700]) * rnd.random()))
    a = [(rnd.choice("xy"), rnd.choice(["p", "q", None]), *span()) for _ in range(150)] + [("x", "p", None, 3), (None, "p", 0, 500), ("x", "p", 5, 4)]
    b = [(rnd.choice("xyz"), rnd.choice(["u", "v", None]), *span()) for _ in range(200)] + [("x", "u", 3, None), (None, "u", 0, 500)]
    ta = spark.createDataFrame(a, "g string, f string, a0 long, a1 long").repartition(3)
    tb = spark.createDataFrame(b, "g string, k string, b0 long, b1 long").repartition(3)
    ok = lambda x: None not in x[2:] and x[2] < x[3]
    want, plain = {}, [0, 0]
    for x in filter(ok, a):
        for y in filter(ok, b):
            if (both := min(x[3], y[3]) - max(x[2], y[2])) > 0:
                plain = [plain[0] + 1, plain[1] + both]
                if x[0] is not None and x[0] == y[0]:
                    n, length = want.get((x[0], x[1], y[1]), (0, 0))
                    want[x[0], x[1], y[1]] = n + 1, length + both
    for size in (30, 10**6):
        got = intervals.overlap_totals(ta, tb, ("a0", "a1"), ("b0", "b1"), ("g",), ("f",), ("k",), size=size)
        assert got.columns == ["g", "f", "k", "n", "length"]
        assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want
    assert [list(r) for r in intervals.overlap_totals(ta, tb, ("a0", "a1"), ("b0", "b1")).collect()] == [plain]
    assert intervals.overlap_totals(ta.limit(0), tb, ("a0", "a1"), ("b0", "b1"), ("g",)).count() == 0
    many = spark.range(300_000).select((F.col("id") % 50).alias("s"), (F.col("id") % 50 + 100).alias("e"))  # 9 * 10^10 pairs
    far = intervals.overlap_totals(many.toDF("a0", "a1"), many.toDF("b0", "b1"), ("a0", "a1"), ("b0", "b1")).first()
    assert far["n"] == 300_000**2 and far["length"] == 6000**2 * sum(100 - abs(i - j) for i in range(50) for j in range(50))


def test_overlap_counts_order_positions_only(spark, monkeypatch):
    seen, running = [], ranges.running
    monkeypatch.setattr(ranges, "running", lambda rows, *more, **named: seen.append(rows.count()) or running(rows, *more, **named))
    a = spark.range(6000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("a0"), (F.col("id") % 7 + 2).alias("a1"))
    b = spark.range(9000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("b0"), (F.col("id") % 5 + 1).alias("b1"))
    got = intervals.overlap_counts(a, b, ("a0", "a1"), ("b0", "b1"), "g")
    found = Counter(tuple(r) for r in got.collect())
    each = {s: 600 * sum(s < k + 1 and k < s + 2 for k in range(5)) for s in range(7)}
    assert found == Counter((g if g < 2 else None, i % 7, i % 7 + 2, each[i % 7] if g < 2 else 0) for i in range(6000) for g in [i % 3])  # null keys meet nothing
    assert seen and max(seen) < 100


def test_tiled_products(spark):
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(-3, 4, (23, 41)), rnd.integers(-3, 4, (41, 17))
    a[rnd.random(a.shape) < 0.7] = 0
    a[:, 5] = 1  # a busy inner index
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")
    for rows, cols in ((4, 2), (64, 64), (5, 3)):
        x, y = tiles.from_cells(cells(a), rows, cols, a.shape), tiles.from_cells(cells(b), cols, rows, b.shape)
        made = tiles.product(x, y)
        out = np.zeros((23, 17))
        for r in made.df.collect():
            t = made.tile(r["bi"], r["bj"], bytes(r["v"]))
            out[r["bi"] * rows :, r["bj"] * rows :][: t.shape[0], : t.shape[1]] = t
        assert (out == a @ b).all()
        gram = {(r["i"], r["j"]): r["v"] for r in tiles.gram_rows(x).collect()}
        assert len(gram) == 23 * 23 and all(v == (a @ a.T)[k] for k, v in gram.items())
        total = {r["i"]: r["t"] for r in tiles.gram_rows(x, tiles.row_summary(x), "i long, total double, largest double").groupBy("i").agg(F.sum("total").alias("t")).collect()}
        assert [total[i] for i in range(23)] == (a @ a.T).sum(1).tolist()
    got = {(r["i"], r["j"]): r["v"] for r in tiles.matmul(cells(a), cells(b), 4, 3).collect()}
    assert all(got.get((i, j), 0.0) == (a @ b)[i, j] for i in range(23) for j in range(17))
    with pytest.raises(ValueError, match="inner sizes"):
        tiles.product(x, x)


def test_gram_summary_multiplies_distinct_rows_only(spark, monkeypatch):
    heights, product = [], tiles.product
    monkeypatch.setattr(tiles, "product", lambda a, *more, **named: heights.append(a.height) or product(a, *more, **named))
    rnd = np.random.default_rng(12)
    kinds = rnd.integers(-3, 4, (7, 5)) * (rnd.random((7, 5)) < 0.6)
    kinds[0], kinds[1, :], kinds[2, :] = 0, [-2, 0, 0, 0, 0], [0, 0, 0, 0, -1]
    for which, rows, cols in ((rnd.integers(0, 7, 400), 64, 4), (np.arange(7), 1, 1), (np.array([1, 2, 2]), 1, 1), (np.array([1, 1]), 4, 4)):
        heights.clear()
        m = kinds[which]
        cells = [(int(9 * i), int(j), float(m[i, j])) for i in range(len(m)) for j in range(5) if m[i, j] or j == 0]
        got = {r["i"]: (r["total"], r["largest"]) for r in tiles.gram_summary(spark.createDataFrame(cells, "i long, j long, v double").repartition(3), rows, cols).collect()}
        g = m @ m.T
        assert got == {9 * i: (float(g[i].sum()), float(g[i].max())) for i in range(len(m))}
        assert heights == [len({tuple(r) for r in m.tolist()})]
    assert tiles.gram_summary(spark.createDataFrame([], "i long, j long, v double")).count() == 0


@pytest.mark.parametrize(("narrow", "broadcast"), [(64, 10**6), (64, 0), (2, 10**6)])
def test_gram_of_narrow_rows_makes_cells_in_one_place(spark, monkeypatch, narrow, broadcast):
    for name, value in (("NARROW", narrow), ("BROADCAST_CELLS", broadcast), ("PAIRS", 100)):
        monkeypatch.setattr(linalg, name, value)
    rnd = random.Random(13)
    cells = [(i, j, float(rnd.randrange(-4, 5))) for i in range(40) for j in (3, 70, 900) if rnd.random() < 0.6]
    table = spark.createDataFrame([*cells, cells[0]], "i long, j long, v double")  # one cell twice
    found = linalg.gram_rows(table)
    want = Counter()
    for i, j, x in [*cells, cells[0]]:
        for k, l, y in [*cells, cells[0]]:  # noqa: E741
            if j == l:
                want[i, k] += x * y
    rows = found.collect()
    assert len(rows) == len(want) and {(r["i"], r["j"]): r["v"] for r in rows} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert narrow == 2 or ("Aggregate" not in plan and "SortMergeJoin" not in plan)
    assert linalg.gram_rows(table.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_gram_of_narrow_rows_comes_in_blocks_that_files_hold_in_little_space(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", broadcast)
    rnd = np.random.default_rng(14)
    m = rnd.integers(100, 400, (60, 3))[rnd.integers(0, 60, 1200)]
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(3)], "i long, j long, v double").repartition(3)
    path = tmp_path / "cells"
    linalg.gram_rows(cells).write.parquet(str(path))
    written = sum(f.stat().st_size for f in path.glob("*.parquet"))
    assert written < 0.3 * len(m) ** 2
    got = spark.read.parquet(str(path)).toPandas()
    g = np.full((len(m), len(m)), np.nan)
    g[got.i, got.j] = got.v
    assert len(got) == len(m) ** 2 and (g == m @ m.T).all()


def test_gram_of_narrow_rows_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(linalg, "FLAT", 7)
    monkeypatch.setattr(linalg, "PAIRS", 150)
    cells = [(i, j, float((i * 37 + j) % 5)) for i in range(100) for j in range(2) if (i + j) % 3]
    for broadcast in (10**6, 0):
        monkeypatch.setattr(linalg, "BROADCAST_CELLS", broadcast)
        found = linalg.gram_rows(spark.createDataFrame(cells, "i long, j long, v double")).withColumn("task", F.spark_partition_id()).collect()
        want = Counter()
        for i, j, x in cells:
            for k, l, y in cells:  # noqa: E741
                if j == l:
                    want[i, k] += x * y
        assert len(found) == len(want) and {(r["i"], r["j"]): r["v"] for r in found} == want
        if broadcast:
            right = {}
            for r in found:
                right.setdefault(r["task"], set()).add(r["j"])
            assert len(right) == 75 and max(map(len, right.values())) == 7


def test_parts_of_tiles_are_summed_in_steps(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SIDE", 1)
    monkeypatch.setattr(tiles, "SUMMED", 3)
    a = np.arange(60).reshape(3, 20) % 7
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(20)], "i long, j long, v double")
    got = {(r["i"], r["j"]): r["v"] for r in tiles.gram_rows(tiles.from_cells(cells, 2, 1)).collect()}
    assert got == {(i, j): float((a @ a.T)[i, j]) for i in range(3) for j in range(3)}


def test_blocked_tridiagonal(spark):
    rnd = random.Random(6)
    systems = {"plain": [rnd.gauss(0, 1) for _ in range(57)], "zero diagonal": [0.0] * 58, "one": [4.0], "two": [0.0, 3.0], None: [1e-3] * 40}
    rows, want = [], {}
    for name, diag in systems.items():
        n = len(diag)
        sub, sup, rhs = ([rnd.gauss(0, 1) for _ in range(n)] for _ in range(3))
        m = np.diag(diag) + np.diag(sub[1:], -1) + np.diag(sup[:-1], 1)
        want |= {(name, i): v for i, v in enumerate(np.linalg.solve(m, rhs))}
        rows += [(name, i, sub[i], diag[i], sup[i], rhs[i]) for i in range(n)]
    rows += [("singular", i, 1.0, 1.0 if i else 0.0, 0.0, 1.0) for i in range(9)]
    table = spark.createDataFrame(rows, "grp string, i long, sub double, diag double, sup double, rhs double").repartition(4)
    for block in (1, 2, 7, 20_000):
        got = {(r["grp"], r["i"]): r["x"] for r in banded.solve(table, block=block).collect()}
        assert len(got) == len(rows) and all(got["singular", i] is None for i in range(9))
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-7), (block, k)
    assert banded.solve(table.limit(0)).count() == 0


def test_least_squares_of_any_degree(spark):
    rnd = random.Random(7)
    points = [(g, rnd.uniform(-2, 3), rnd.gauss(0, 2)) for g, n in (("a", 60), ("b", 9), (None, 30)) for _ in range(n)] + [("few", 1.0, 5.0), ("few", 2.0, 7.0), ("few", 2.0, 9.0)]
    table = spark.createDataFrame(points, "grp string, t double, y double").repartition(3)
    for degree in (2, 5):
        fit = interp.least_squares(table, degree)
        assert fit.count() == 4
        values = {(r["grp"], r["t"]): r["value"] for r in interp.least_squares_value(fit, table.where("grp is not null").select("grp", "t")).collect()}
        for g in ("a", "b"):
            x, y = np.array([p[1:] for p in points if p[0] == g]).T
            fitted = np.polyval(np.polyfit(x, y, degree), x)
            assert [values[g, t] for t in x] == pytest.approx(fitted, abs=1e-6)
            assert fit.where(F.col("grp") == g).first()["rms"] == pytest.approx(np.sqrt(np.mean((fitted - y) ** 2)), abs=1e-8)
        assert values["few", 1.0] == pytest.approx(5) and values["few", 2.0] == pytest.approx(8)


@pytest.mark.parametrize("size", [25, 10**6])
def test_areas_to_knots_in_ranges(spark, size):
    rnd = random.Random(8)
    cells, want = [], {}
    for g, n in (("a", 101), ("b", 2), ("c", 1)):
        t = np.cumsum([rnd.uniform(0.5, 2) for _ in range(n + 1)])
        h, area = np.diff(t), np.array([rnd.gauss(3, 1) for _ in range(n)])
        base, free = np.zeros(n + 1), (-1.0) ** np.arange(n + 1)
        for i in range(n):
            base[i + 1] = 2 * area[i] / h[i] - base[i]
        x, z = (np.diff(np.diff(v) / h) for v in (base, free))
        s = -(x @ z) / (z @ z) if n > 1 else area[0] / h[0]
        want |= {(g, round(a, 9)): b for a, b in zip(t, base + s * free, strict=True)}
        cells += [(g, float(t[i]), float(t[i + 1]), float(area[i])) for i in range(n)]
    table = spark.createDataFrame(cells, "grp string, t0 double, t1 double, area double").repartition(3)
    got = {(r["grp"], round(r["t"], 9)): r["y"] for r in interp.linear_from_integrals(table, size=size).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
