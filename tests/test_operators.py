"""Mathematical properties of the operators."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.operators import asof, assoc, glasso, interp, intervals, linalg


def knots(spark, f, ts=(0.0, 1.0, 2.5, 4.0, 7.0), grp="g"):
    return spark.createDataFrame([(grp, float(t), float(f(t))) for t in ts], "grp string, t double, y double")


def at(spark, ts, grp="g"):
    return spark.createDataFrame([(grp, float(t)) for t in ts], "grp string, t double")


def read(df, c="value"):
    return [r[c] for r in df.orderBy("t").collect()]


Q = [-1.0, 0.0, 0.3, 1.0, 2.0, 3.9, 5.0, 7.0, 8.0]


def test_bracket_edges(spark):
    k = knots(spark, lambda t: t)
    for bucket in (None, 1.5):
        got = [(r["lo"]["t"], r["hi"]["t"], r["lo"]["i"]) for r in asof.bracket(k, at(spark, Q), bucket=bucket).orderBy("t").collect()]
        assert got == [(0, 1, 0), (0, 1, 0), (0, 1, 0), (1, 2.5, 1), (1, 2.5, 1), (2.5, 4, 2), (4, 7, 3), (4, 7, 3), (4, 7, 3)]
    one = asof.bracket(knots(spark, lambda t: 5, ts=(3.0,)), at(spark, [1, 3, 9])).collect()
    assert all(r["lo"]["y"] == 5 for r in one)
    assert asof.bracket(k, at(spark, [1], grp="other")).first()["lo"] is None


def test_step(spark):
    assert read(asof.step_value(knots(spark, lambda t: 10 * t), at(spark, Q))) == [0, 0, 10, 10, 25, 40, 70, 70, 70]


@pytest.mark.parametrize("name", ["linear", "b_spline", "overhauser", "pchip", "cubic"])
def test_linear_data_through_every_spline(spark, name):
    ts = range(8) if name == "b_spline" else (0.0, 1.0, 2.5, 4.0, 7.0)
    out = read(getattr(interp, name)(knots(spark, lambda t: 2 * t + 1, ts), at(spark, Q)))
    assert np.allclose(out, [2 * q + 1 for q in Q])


def test_exact_parabolas(spark):
    f = lambda t: t * t - 3 * t
    assert np.allclose(read(interp.quadratic(knots(spark, f), at(spark, Q))), [f(q) for q in Q])
    assert np.allclose(read(interp.overhauser(knots(spark, f), at(spark, Q[1:-1]))), [f(q) for q in Q[1:-1]])
    assert np.allclose(read(interp.cubic(knots(spark, f), at(spark, Q), (2, 2.0), (2, 2.0))), [f(q) for q in Q])
    assert np.allclose(read(interp.cubic(knots(spark, f), at(spark, Q), (1, -3.0), (1, 11.0))), [f(q) for q in Q])


def test_cubic_exact_and_defined(spark):
    f = lambda t: t**3 - t
    out = interp.cubic(knots(spark, f), at(spark, Q), (2, 0.0), (2, 42.0))
    assert np.allclose(read(out), [f(q) for q in Q]) and np.allclose(read(out, "second"), [6 * q for q in Q])
    two = interp.cubic(knots(spark, f, (0.0, 2.0)), at(spark, [0.5, 1.0]))
    assert np.allclose(read(two), [1.5, 3.0])
    slopes = knots(spark, f).withColumn("slope", 3 * F.col("t") * F.col("t") - 1)
    assert np.allclose(read(interp.hermite(slopes, at(spark, Q))), [f(q) for q in Q])
    c = {r["t"]: r for r in interp.hermite_coefficients(slopes).collect()}
    assert np.allclose([c[1.0][k] for k in ("c0", "c1", "c2", "c3")], [0, 2, 3, 1])


def test_integral(spark):
    limits = spark.createDataFrame([("g", 0.0, 7.0), ("g", 0.3, 0.2), ("g", 5.0, 1.0), ("g", -1.0, 8.0)], "grp string, a double, b double")
    got = {(r["a"], r["b"]): r["integral"] for r in interp.linear_integral(knots(spark, lambda t: 2 * t), limits).collect()}
    assert all(math.isclose(v, b * b - a * a, abs_tol=1e-9) for (a, b), v in got.items()) and len(got) == 4


def test_pchip_is_monotone(spark):
    ys = dict(zip((0.0, 1.0, 2.5, 4.0, 7.0), (0, 0.1, 5, 5, 9), strict=True))
    k = knots(spark, ys.get)
    out = interp.pchip(k, at(spark, np.linspace(0, 7, 141)))
    v = np.array(read(out))
    assert (np.diff(v) >= -1e-12).all() and interp.count_outside(out).first()["n_outside"] == 0
    assert np.allclose(read(interp.pchip(k, at(spark, ys))), list(ys.values()))


def test_tridiagonal(spark):
    rng = np.random.default_rng(3)
    n = 12
    sub, sup, x = rng.random(n), rng.random(n), rng.random(n)
    diag = 3 + rng.random(n)
    m = np.diag(diag) + np.diag(sub[1:], -1) + np.diag(sup[:-1], 1)
    df = spark.createDataFrame([(sub.tolist(), diag.tolist(), sup.tolist(), (m @ x).tolist())], "a array<double>, b array<double>, c array<double>, d array<double>")
    assert np.allclose(df.select(interp.tridiagonal_solve(*map(F.col, "abcd"))).first()[0], x)
    zero = df.withColumn("b", F.array_repeat(F.lit(0.0), n)).withColumn("a", F.col("b"))
    assert zero.select(interp.tridiagonal_solve(*map(F.col, "abcd"))).first()[0] is None
    rows = spark.createDataFrame([("g", i, float(sub[i]), float(diag[i]), float(sup[i]), float(x[i])) for i in range(n)], "grp string, i int, sub double, diag double, sup double, x double")
    assert np.allclose([r["v"] for r in interp.tridiagonal_multiply(rows).orderBy("i").collect()], m @ x)


def test_areas(spark):
    cells = spark.createDataFrame([("g", 0.0, 1.0, 1.0), ("g", 1.0, 3.0, 8.0), ("g", 3.0, 4.0, 7.0)], "grp string, t0 double, t1 double, area double")
    assert np.allclose([r["y"] for r in interp.linear_from_integrals(cells).orderBy("t").collect()], [0, 2, 6, 8])


def test_bases(spark):
    one = spark.range(1)
    for u in (0.0, 0.25, 1.0):
        w = one.select(F.array(*interp.beta_weights(F.lit(u), 1.7, 4.0)), interp.bernstein_basis(5, F.lit(2 + 3 * u), 2.0, 5.0)).first()
        assert math.isclose(sum(w[0]), 1) and math.isclose(sum(w[1]), 1)
        ys = [3.0, -1.0, 2.0, 7.0]
        direct = one.select(sum((a * y for a, y in zip(interp.beta_weights(F.lit(u), 1.7, 4.0), ys, strict=True)), F.lit(0.0))).first()[0]
        assert math.isclose(direct, one.select(interp.basis_value(F.lit(u), interp.beta_uniform_basis(1.7, 4.0), [F.lit(y) for y in ys])).first()[0], abs_tol=1e-9)
    assert np.allclose(interp.beta_uniform_basis(1.0, 0.0), interp.BASIS["b_uniform"])
    assert np.allclose(interp.overhauser_basis(0.5, 0.5), interp.BASIS["overhauser_uniform"])
    bumps = [sum(one.select(interp.beta_basis(F.lit(t), [s, s + 1, s + 2, s + 3, s + 4])).first()[0] for s in range(-4, 1)) for t in (0.0, 0.5)]
    assert np.allclose(bumps, 1)
    control = F.array(*(F.lit(float(c)) for c in (1, 2, 4)))
    assert math.isclose(one.select(interp.bezier(control, 2, F.lit(0.5))).first()[0], 2.25)
    with pytest.raises(ValueError):
        interp.bernstein_basis(2, F.lit(0.5), 1.0, 1.0)


def test_polynomials(spark):
    f = lambda t: t**3 - 2 * t + 1
    a = interp.knot_arrays(knots(spark, f)).withColumn("c", interp.divided_differences(F.col("ts"), F.col("ys")))
    assert np.allclose(a.select(interp.newton_value(F.col("ts"), F.col("c"), F.lit(3.3))).first()[0], f(3.3))
    fit = interp.least_squares(knots(spark, f), 3)
    assert fit.first()["rms"] < 1e-9 and np.allclose(read(interp.least_squares_value(fit, at(spark, Q))), [f(q) for q in Q])
    ts = (0.0, 1.0, 2.5, 4.0, 7.0)
    slope, start = np.polyfit(ts, [f(t) for t in ts], 1)
    line = interp.least_squares(knots(spark, f), 1)
    assert np.allclose(read(interp.least_squares_value(line, at(spark, Q))), [start + slope * q for q in Q])
    assert math.isclose(line.first()["rms"], np.sqrt(np.mean([(start + slope * t - f(t)) ** 2 for t in ts])))
    assert interp.bad_knots(knots(spark, f, (1.0, 1.0))).count() == 1 and interp.bad_knots(knots(spark, f)).count() == 0


def test_bins_and_segments(spark):
    rnd = random.Random(4)
    points = [rnd.randrange(-50, 1200) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in points], "x int")
    got = {r["bin"]: r["n"] for r in intervals.bin_counts(df, "x", 0, 1000, 10, 150).collect()}
    expected = {k: sum(10 * k <= p < 10 * k + 150 for p in points) for k in range(100)}
    assert got == {k: n for k, n in expected.items() if n}
    starts = sorted({10 * rnd.randrange(0, 2_500_000) for _ in range(50)} | set(range(9_999_900, 10_000_200, 10)) | set(range(19_999_990, 20_000_010, 10)))
    bins = spark.createDataFrame([(s, 1.0 + s % 7) for s in starts], "start long, r double")
    for by in ((), ("k",)):
        segs = sorted((r["start"], r["end"], r["n"]) for r in intervals.segments(bins.withColumn("k", F.lit(1)), 10, by=by, score="r").collect())
        runs, at_ = [], None
        for s in starts:
            if at_ is not None and s == at_[1]:
                at_ = (at_[0], s + 10, at_[2] + 1)
                runs[-1] = at_
            else:
                at_ = (s, s + 10, 1)
                runs.append(at_)
        assert segs == runs and all((b - a) / 10 == n for a, b, n in segs)
    ends = intervals.interval_ends(spark.createDataFrame([("s", 3, 9)], "sample string, start int, end int"))
    assert sorted(r["position"] for r in ends.collect()) == [3, 9]


def test_association(spark):
    rows = [(b, s, s % 3, (s % 3) * 2 + 1 if b == 0 else (s * 7 + b) % 5) for b in range(3) for s in range(12)]
    df = spark.createDataFrame(rows, "bin int, sample int, dosage int, n int")
    got = {r["bin"]: r["ratio"] for r in assoc.score_bins(df).collect()}
    assert got[0] == math.inf
    for b in (1, 2):
        x, y = np.array([r[2] for r in rows if r[0] == b], float), np.array([r[3] for r in rows if r[0] == b], float)
        left = y - np.polyval(np.polyfit(x, y, 1), x)
        assert math.isclose(got[b], np.linalg.norm(y - y.mean()) / np.linalg.norm(left), rel_tol=1e-9)
    samples = df.select("sample", "dosage").distinct()
    dealt = assoc.permuted(samples, 5)
    assert dealt.count() == 60 and dealt.groupBy("rep", "dosage").count().where("count != 4").count() == 0
    p = assoc.permutation_p(spark.createDataFrame([(1, 2.0), (2, 9.0)], "bin int, ratio double"), spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, 4.0)], "bin int, ratio double"))
    assert {r["bin"]: r["p"] for r in p.collect()} == {1: 2 / 3, 2: 1 / 3}


def test_false_discovery(spark):
    rnd = random.Random(7)
    ps = [rnd.choice([rnd.random() ** 4, 0.03, 0.5, 1.0, 1e-12]) for _ in range(200)]
    got = {(r["k"]): r["q"] for r in assoc.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "k int, p double")).collect()}
    order = np.argsort(ps)
    q = np.minimum.accumulate((np.array(ps)[order] * len(ps) / np.arange(1, len(ps) + 1))[::-1])[::-1]
    expected = dict(zip(order.tolist(), np.minimum(q, 1), strict=True))
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in got)


def cells_of(spark, matrices):
    return spark.createDataFrame([(m, i, j, float(a[i][j])) for m, a in matrices.items() for i in range(len(a)) for j in range(len(a))], "m string, i int, j int, v double")


def test_linear_algebra(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((4, 3)), rng.random((3, 5))
    table = lambda x: spark.createDataFrame([(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], linalg.CELLS)

    def back(df, shape):
        out = np.zeros(shape)
        for r in df.collect():
            out[r["i"], r["j"]] = r["v"]
        return out

    assert np.allclose(back(linalg.matmul(table(a), table(b)), (4, 5)), a @ b)
    assert np.allclose(back(linalg.gram_rows(table(a)), (4, 4)), a @ a.T) and np.allclose(back(linalg.gram_columns(table(a)), (3, 3)), a.T @ a)
    assert np.allclose(back(linalg.gram_of_arrays(spark.createDataFrame([(r.tolist(),) for r in a], "x array<double>"), "x"), (3, 3)), a.T @ a)
    assert np.allclose(back(linalg.subtract(linalg.add(table(a), table(a)), linalg.scale(table(a), 0.5)), a.shape), 1.5 * a)
    assert np.allclose(back(linalg.rotate(table(a), 4), (3, 4)), np.rot90(a, -1))
    assert linalg.lower(table(b)).count() == 6 and tuple(linalg.dims(table(b)).first()) == (3, 5)
    assert np.allclose(back(linalg.shift(linalg.constant(spark, 2, 3, 4.0), 1.0), (2, 3)), 5) and linalg.get(linalg.put(table(a), 1, 1, 9.0), 1, 1).first()["v"] == 9
    spd = a.T @ a + np.eye(3)
    m = cells_of(spark, {"spd": spd, "bad": np.array([[1.0, 2.0], [2.0, 1.0]])})
    factor = linalg.cholesky(m)
    assert np.allclose(back(factor.where("m = 'spd'"), (3, 3)), np.linalg.cholesky(spd)) and factor.where("m = 'bad'").count() == 0
    assert math.isclose(linalg.log_determinant(factor).first()["logdet"], np.linalg.slogdet(spd)[1])
    assert np.allclose(back(linalg.inverse(m.where("m = 'spd'")), (3, 3)), np.linalg.inv(spd))
    e = linalg.eigen(m.where("m = 'spd'"))
    rebuilt = sum(r["value"] * np.outer(r["vector"], r["vector"]) for r in e.collect())
    assert np.allclose(rebuilt, spd) and math.isclose(linalg.condition_number(e).first()["condition"], np.linalg.cond(spd))
    assert linalg.tied_argmin(spark.createDataFrame([(1.0, 3), (2.0, 1), (4.0, 1)], "c double, v int"), "c", "v").first()["c"] == 3.0


@pytest.mark.parametrize("method", glasso.METHODS)
def test_glasso(spark, method):
    rng = np.random.default_rng(2)
    s = np.cov(rng.random((30, 6)) @ rng.random((6, 6)), rowvar=False)
    s /= s.max()
    p, gap, _ = glasso.solve(s, 0.1, method, tol=1e-7)
    x = np.linalg.inv(p)
    assert -1e-9 <= gap < 1e-6 and (np.abs(x - s) <= 0.1 + 1e-9).all() and np.allclose(np.diag(x), np.diag(s) + 0.1)
    assert np.allclose(p, glasso.solve(s, 0.1, "adm", tol=1e-8)[0], atol=2e-3)
    one, two = glasso.solve(np.array([[2.0]]), 0.5, method)[0], glasso.solve(np.array([[1.0, 0.6], [0.6, 1.0]]), 0.2, method, tol=1e-9)[0]
    assert math.isclose(one[0, 0], 0.4) and np.allclose(np.linalg.inv(two), [[1.2, 0.4], [0.4, 1.2]], atol=1e-4)


def test_glasso_table_and_pairs(spark):
    cells = cells_of(spark, {"a": np.array([[1.0, 0.6], [0.6, 1.0]]), "b": np.eye(2)})
    got = {(r["m"], r["i"], r["j"]): r["v"] for r in glasso.graphical_lasso(cells, [0.2]).collect()}
    assert abs(got["b", 0, 1]) < 1e-9 and got["a", 0, 1] < 0
    s = np.array([[1.0, 0.3], [0.3, 1.0]])
    p1, p2, _ = glasso.solve_pair(s, s, 0.1)
    assert np.allclose(p1, np.linalg.inv(s), atol=1e-4) and np.allclose(p1, p2)
    q1, q2, _ = glasso.solve_pair(s, np.eye(2), 10.0)
    assert abs(q1[0, 1] - q2[0, 1]) < 1e-5
    assert 0 <= glasso.tune_momentum(np.eye(4) + 0.3, 0.2, reps=3, size=3) <= 0.95


def test_vectors(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(vectors.larger(lit(1.0), lit(2.0))) == 2 and get(vectors.smaller(lit(1.0), lit(2.0))) == 1 and get(vectors.larger(lit(float("nan")), lit(2.0))) == 2 and get(vectors.smaller(lit(2.0), lit(float("nan")))) == 2
    assert get(vectors.even_grid(lit(5), lit(0.0), lit(2.0))) == [0, 0.5, 1, 1.5, 2] and get(vectors.even_grid(lit(1), lit(0.0), lit(2.0))) == [1]
    u, seed = [], 11
    for _ in range(4):
        seed = seed * 16807 % 2147483647
        u.append(seed * 4.656612875e-10)
    assert get(vectors.lcg_uniforms(lit(11), lit(4))) == u and np.allclose(get(vectors.lcg_between(lit(11), lit(4), lit(2.0), lit(4.0))), [2 + 2 * x for x in u])
    h = 0
    for c in "NATION_1":
        h = (h * 33 + ord(c)) % 2**32
    assert get(vectors.string_hash(lit("NATION_1"))) == h and get(vectors.trimmed_length(lit("ab  "))) == 2
    assert get(vectors.sign_test(lit(-2.0), lit(3.0))) == -1 and get(vectors.soft_threshold(lit(-0.5), lit(0.2))) == -0.3 and get(vectors.clamp(lit(9), lit(1), lit(3))) == 3
    m = F.create_map(lit("a"), lit(1), lit("b"), lit(2))
    assert get(vectors.put(m, lit("a"), lit(5)))["a"] == 5 and get(vectors.drop_key(m, lit("a"))) == {"b": 2} and get(vectors.lookup(m, lit("z"), lit(0))) == 0 and get(vectors.stored_key(m, lit("z"))) is None
    a = F.array(lit(1), lit(2), lit(3))
    assert get(vectors.delete_at(a, 1)) == [1, 3] and get(vectors.delete_at(a, 2)) == [1, 2] and get(vectors.push_front(a, lit(0))) == [0, 1, 2, 3] and get(vectors.push_back(a, lit(4)))[-1] == 4 and get(vectors.truncate(a, 2)) == [1, 2]
    assert get(vectors.ones_up(lit(3))) == [1, 2, 3]
    for values, kind in (([1, 1], 0), ([1, 2], 2), ([1, 1, 2], 1), ([2, 1], 4), ([2, 2, 1], 3), ([1, 2, 1], -1), ([5], 0)):
        df = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)], "g string, k int, v int")
        assert vectors.order_type(df, "g", "k", "v").first()["order_type"] == kind, values
    assert math.isclose(get(vectors.momentum(lit(0.3))), glasso.momentum(0.3))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_and_names(spark):
    import __spark_entry__

    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and __spark_entry__.entry(spark).count() > 0


def test_scores_of_counts_need_no_grid(spark):
    samples = spark.createDataFrame([(k, k % 3 if k else None) for k in range(20)], "sample long, dosage int")
    counts = spark.createDataFrame([(b, s, 1 + (s * b) % 4) for b in range(4) for s in range(b, 20, 2)], "bin long, sample long, n long")
    bins = spark.range(6).withColumnRenamed("id", "bin")
    want = {r["bin"]: r["ratio"] for r in assoc.score_bins(assoc.complete(counts, samples, bins).join(samples, "sample")).collect()}
    got = {r["bin"]: r["ratio"] for r in assoc.score_counts(counts, samples, bins).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[b], want[b]) for b in want)
    many = spark.range(100_002).select(F.col("id").alias("sample"), (F.col("id") % 3).alias("dosage"))
    assert assoc.score_counts(counts, many, bins).count() == 6


@pytest.mark.parametrize("size", [40, 10**6])
def test_scores_of_steps_make_no_row_for_sample_and_bin(spark, size):
    rnd = random.Random(3)
    points = spark.createDataFrame([(k % 30, rnd.randrange(-20, 1200)) for k in range(900)], "sample long, x long").repartition(3)
    bins = intervals.bin_grid(spark, 0, 1000, 10)
    named = {"low": 0, "high": 1000, "spacing": 10, "size": 150, "by": ("sample",)}
    counts, steps = intervals.bin_counts(points, "x", **named), intervals.bin_steps(points, "x", **named)
    assert steps.count() <= 2 * points.count() < counts.count()
    samples = spark.createDataFrame([(rep, s, None if s == 7 else (s * rep) % 3) for rep in (1, 2) for s in range(33)], "rep int, sample long, dosage int")
    for by, who, where in (((), samples.where("rep = 2").drop("rep"), bins), (("rep",), samples, bins.where("bin % 3 = 1 or bin > 90"))):
        got, want = ({tuple(r)[: len(by) + 1]: tuple(r)[len(by) + 1 :] for r in x.select(*by, "bin", "ratio", "effect", "mean").collect()} for x in (assoc.score_steps(steps, who, where, by, size), assoc.score_counts(counts, who, where, by)))
        assert got.keys() == want.keys() and len(want) == where.count() * max(1, 2 * len(by))
        assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_covariance_of_arrays(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12)) + 3
    rows = [(("a", "b", None)[k % 3], v.tolist()) for k, v in enumerate(x)] + [("a", None), ("z", x[0].tolist())]
    cells = linalg.covariance_of_arrays(spark.createDataFrame(rows, "m string, v array<double>").repartition(5), "v", "m").collect()
    for k, m in enumerate(("a", "b", None)):
        got = np.full((12, 12), np.nan)
        for r in cells:
            if r["m"] == m:
                got[r["i"], r["j"]] = r["v"]
        assert np.allclose(got, np.cov(x[k::3].T))
    assert {r["v"] for r in cells if r["m"] == "z"} == {None}


def test_g1_glasso_has_all_dimensions(spark, tmp_path):
    from marlstone.plans import catalogue

    rng = np.random.default_rng(5)
    rows = [(k % 2, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 64)) / 8)]
    spark.createDataFrame(rows, "label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalogue.QUERIES["g1_glasso"](spark, str(tmp_path)).collect()
    assert len(found) == 2 * 2 * 64 * 64 and all(r["solved"] for r in found)


def test_long_splines_in_blocks_equal_the_dense_solution(spark):
    import numpy as np

    from marlstone.operators import interp

    rnd = np.random.default_rng(4)
    n = 900
    t, y = np.cumsum(rnd.uniform(0.01, 3.0, n)), rnd.normal(size=n)
    knots = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)] + [("b", 0.0, 1.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0)], "grp string, t double, y double")
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    for start, end in (((0, 0.0), (1, 2.0)), ((2, 0.5), (0, 0.0))):
        m, r = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2], r[i] = (h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6), d[i] - d[i - 1]
        m[0, :2], r[0] = {0: ((1, -1), 0.0), 1: ((h[0] / 3, h[0] / 6), d[0] - start[1]), 2: ((1, 0), start[1])}[start[0]]
        m[-1, -2:], r[-1] = {0: ((-1, 1), 0.0), 1: ((h[-1] / 6, h[-1] / 3), end[1] - d[-1]), 2: ((0, 1), end[1])}[end[0]]
        want = np.linalg.solve(m, r)
        got = {(x["grp"], x["t"]): x["ypp"] for x in interp.cubic_second_derivatives(knots, start, end, block=150).collect()}
        assert len(got) == n + 2
        assert np.allclose([got["a", float(a)] for a in t], want, rtol=1e-12, atol=1e-12)


def test_cells_of_bins_for_any_spacing_and_size(spark):
    from marlstone.operators import intervals

    points = [float(x) for x in (0, 3, 7, 7.5, 12, 12, 29.9, 30, 41, 55)]
    table = spark.createDataFrame([(x,) for x in points], "x double")
    for spacing, size in ((10, 15), (6, 4), (7, 21), (5, 5)):
        got = {r["bin"]: r["n"] for r in intervals.bin_counts(table, "x", 3, 45, spacing, size).collect()}
        want = {k: n for k in range(42 // spacing) if (n := sum(3 + k * spacing <= x < 3 + k * spacing + size for x in points))}
        assert got == want


def test_paired_and_masked_solvers(spark):
    import numpy as np

    from marlstone.operators import glasso

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 4))
    s = np.cov((x + 0.8 * x[:, :1]).T)
    best, gap, _ = glasso.solve(s, 0.1, "heavy_ball", tol=1e-10)
    for method in glasso.METHODS:
        p, gap, _ = glasso.solve(s, 0.1, method, tol=1e-9)
        assert np.allclose(p, best, atol=2e-3), method
    cells = lambda m: spark.createDataFrame([("a", i, j, float(m[i, j])) for i in range(4) for j in range(4)], "m string, i long, j long, v double")
    rows = glasso.paired_lasso(cells(s), cells(s + np.eye(4)), 0.2).collect()
    one, two, _ = glasso.solve_pair(s, s + np.eye(4), 0.2)
    assert len(rows) == 16 and all(abs(r["v1"] - one[r["i"], r["j"]]) < 1e-9 and abs(r["v2"] - two[r["i"], r["j"]]) < 1e-9 for r in rows)
    assert glasso.paired_lasso(cells(s), cells(s).where("false"), 0.2).count() == 0
