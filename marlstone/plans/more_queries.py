"""Further queries of the catalogue, with DuckDB SQL of the same rows: one for each operator that the headline queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import expr, vectors
from marlstone.operators import assoc, glasso, interp, linalg
from marlstone.plans import segment_scan
from marlstone.plans.catalogue import BINS, BRACKET, EV, FOUR, HIGH, MONTHLY, PARABOLA, SIZE, SPACING, events, monthly, query, table
from marlstone.plans.folders import shared_folder
from marlstone.sources import text

# cells of numeric columns as text


@query("""SELECT n_nationkey, (list_contains(['1', '2', '17'], n_nationkey::VARCHAR))::DOUBLE AS in_set, (n_nationkey::VARCHAR = '5')::DOUBLE AS is_five,
contains(n_nationkey::VARCHAR, '1')::DOUBLE AS has_one, (n_nationkey::VARCHAR LIKE '1%')::DOUBLE AS from_one, n_name || n_nationkey::VARCHAR AS label, (n_nationkey + n_regionkey)::DOUBLE AS total, (n_nationkey::VARCHAR < n_name)::DOUBLE AS less FROM nation""")
def e5_numeric_cells(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sources = {"in_set": "n_nationkey IN '1|2|17'", "is_five": "n_nationkey == '5'", "has_one": "n_nationkey HAS '1'", "from_one": "n_nationkey LIKE '1*'", "label": "n_name + n_nationkey", "total": "n_nationkey + n_regionkey", "less": "n_nationkey < n_name"}
    return n.select("n_nationkey", *(expr.expression(n, s).alias(k) for k, s in sources.items()))


@query("""SELECT n_nationkey, (n_regionkey = 1)::DOUBLE AS either, 0.0::DOUBLE AS never, (n_name = 'PERU')::DOUBLE AS quoted, (NOT n_regionkey > 2)::DOUBLE AS negated FROM nation""")
def e19_literals_and_quoted_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sources = {"either": "n_regionkey == 1 OR FALSE", "never": "TRUE AND FALSE", "quoted": "\"n_name\" == 'PERU'", "negated": "NOT n_regionkey > 2"}
    return n.select("n_nationkey", *(expr.expression(n, s).alias(k) for k, s in sources.items()))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'Infinity' ELSE round(l_quantity / l_discount, 4)::VARCHAR END AS ratio FROM lineitem")
def e11_division_by_zero(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = expr.expression(li, "l_quantity / (l_discount + 0)")
    return li.select("l_orderkey", "l_linenumber", F.when(F.abs(v) == float("inf"), F.lit("Infinity")).otherwise(F.round(v, 4).cast("string")).alias("ratio"))


# lines, tables and sets as text


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit(" \t"), F.col("n_regionkey").cast("string"), F.lit("\t\t a b ")).alias("line"))


@query("SELECT n_nationkey, 4 AS n, n_name AS f0, n_regionkey::VARCHAR AS f1, '' AS f2, 'a b' AS f3, '' AS f4 FROM nation")
def s1_fields(spark, sf_dir):
    fields = text.split_fields(F.col("line"))
    return _lines(spark, sf_dir).select("n_nationkey", fields.alias("f")).select("n_nationkey", F.size("f").alias("n"), *(text.cell(F.col("f"), k).alias(f"f{k}") for k in range(5)))


@query("SELECT n_nationkey, 2 AS n, n_name AS f0, n_regionkey::VARCHAR || chr(9) || chr(9) || ' a b' AS f1 FROM nation")
def s2b_field_limit(spark, sf_dir):
    fields = text.split_fields(F.col("line"), limit=2)
    return _lines(spark, sf_dir).select("n_nationkey", fields.alias("f")).select("n_nationkey", F.size("f").alias("n"), *(text.cell(F.col("f"), k).alias(f"f{k}") for k in range(2)))


@query("SELECT n_nationkey, list_filter(regexp_split_to_array(n_name || ',;,' || n_regionkey || ';', '[,; ]+'), lambda x: x <> '')::VARCHAR AS fields FROM nation")
def s2_runs_of_separators(spark, sf_dir):
    line = F.concat(F.lit(";,"), "n_name", F.lit(",;,"), F.col("n_regionkey").cast("string"), F.lit(";"))
    fields = text.split_fields(F.replace(line, F.lit(" "), F.lit(",")), ",", ";", multi=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(fields, ", "), F.lit("]")).alias("fields"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s11_table_round_trip(spark, sf_dir):
    """The nations written as tab-separated text with a header and read back as a table of strings."""
    path = f"{shared_folder(spark)}/nations.tsv"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.csv(path, sep="\t", header=True)
    return text.scan_table(spark, path)


@query("SELECT DISTINCT p_brand AS set_name, p_partkey::VARCHAR AS member FROM part")
def s12_gene_set_file(spark, sf_dir):
    path = f"{shared_folder(spark)}/sets.gmt"
    text.save_gene_sets(text.category_sets(table(spark, sf_dir, "part"), "p_brand", "p_partkey"), path)
    return text.scan_gene_sets(spark, path)


@query("SELECT p_brand AS set_name, p_name AS member FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def s13_translated_sets(spark, sf_dir):
    """All brands' parts, translated by the names of those that were ever returned; others have no translation."""
    path = f"{shared_folder(spark)}/sets.gmt"
    part = table(spark, sf_dir, "part")
    text.save_gene_sets(text.category_sets(part, "p_brand", "p_partkey"), path)
    returned = part.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return text.scan_gene_sets(spark, path, returned.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("id")))


@query("SELECT n_nationkey, CASE WHEN gt IS NULL THEN NULL ELSE len(list_filter(string_split(gt, ''), lambda c: c = 'B')) END::INT AS dosage FROM (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'AA' WHEN 1 THEN 'AB' WHEN 2 THEN 'BB' END AS gt FROM nation)")
def s8_dosage(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    gt = F.when(F.col("n_regionkey") == 0, "AA").when(F.col("n_regionkey") == 1, "AB").when(F.col("n_regionkey") == 2, "BB")
    return n.select("n_nationkey", text.dosage(gt, F.lit("B")).alias("dosage"))


@query("SELECT l_orderkey, l_linenumber, printf('%g', l_extendedprice / 7.3) AS shown FROM lineitem")
def s10_number_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.number_text(F.col("l_extendedprice") / 7.3).alias("shown"))


@query("SELECT n_regionkey::BIGINT AS i, string_agg(printf('%f', n_nationkey / 8), chr(9) ORDER BY n_nationkey) AS line FROM nation GROUP BY n_regionkey")
def s16_matrix_text(spark, sf_dir):
    return text.matrix_text(table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("i"), F.col("n_nationkey").cast("long").alias("j"), (F.col("n_nationkey") / 8).alias("v")))


@query("""WITH c AS (SELECT c_custkey AS member, count(o_custkey) AS n_keys FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT member, n_keys FROM c WHERE n_keys <> 1""")
def j7_check_identifiers(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return text.check_identifiers(members, keys)


@query("SELECT c_nationkey, c_mktsegment AS sample, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def j1_sample_join(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey", F.col("c_mktsegment").alias("sample")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# scalars, vectors and containers


@query("""SELECT l_orderkey, l_linenumber, round(greatest(l_tax, l_discount), 6) AS larger, round(least(l_tax, l_discount), 6) AS smaller, (sign(l_tax - 0.03) * sign(l_discount - 0.05))::DOUBLE + 0.0 AS signs, length(rtrim(l_returnflag || '  ', ' ')) AS trimmed FROM lineitem""")
def v1_larger_smaller_signs(spark, sf_dir):
    li, tax, discount = table(spark, sf_dir, "lineitem"), F.col("l_tax"), F.col("l_discount")
    return li.select(
        "l_orderkey", "l_linenumber", F.round(vectors.larger(tax, discount), 6).alias("larger"), F.round(vectors.smaller(tax, discount), 6).alias("smaller"),
        (vectors.sign_test(tax - 0.03, discount - 0.05) + 0.0).alias("signs"), vectors.trimmed_length(F.concat("l_returnflag", F.lit("  "))).alias("trimmed"),
    )


@query("SELECT n_nationkey, range(1, n_regionkey + 2)::VARCHAR AS up FROM nation")
def v5_indicator(spark, sf_dir):
    up = vectors.ones_up(F.col("n_regionkey") + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(F.transform(up, lambda x: x.cast("string")), ", "), F.lit("]")).alias("up"))


_LCG = "r AS (SELECT n_nationkey, 1 AS k, ((n_nationkey::BIGINT + 1) * 16807) % 2147483647 AS s FROM nation UNION ALL SELECT n_nationkey, k + 1, (s * 16807) % 2147483647 FROM r WHERE k < 12)"


@query(f"WITH RECURSIVE {_LCG} SELECT n_nationkey, k, round(-2 + 5 * (s::DOUBLE * 4.656612875e-10), 9) AS u FROM r WHERE k <= 4")
def v8_uniforms_between(spark, sf_dir):
    u = vectors.lcg_between(F.col("n_nationkey") + 1, F.lit(4), F.lit(-2.0), F.lit(3.0))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(u).alias("k", "u")).select("n_nationkey", (F.col("k") + 1).alias("k"), F.round("u", 9).alias("u"))


@query(f"""WITH RECURSIVE {_LCG}, p AS (SELECT n_nationkey, (k - 1) // 3 AS i, max(CASE WHEN k % 3 = 1 THEN s END) * 4.656612875e-10 AS a, max(CASE WHEN k % 3 = 2 THEN s END) * 4.656612875e-10 AS b, max(CASE WHEN k % 3 = 0 THEN s END) * 4.656612875e-10 AS c FROM r GROUP BY ALL)
SELECT n_nationkey, i::INT AS i, round(CASE WHEN i = 0 THEN 0 ELSE a END, 9) AS sub, round(b, 9) AS diag, round(CASE WHEN i = 3 THEN 0 ELSE c END, 9) AS sup FROM p""")
def v9_random_tridiagonal(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.inline(vectors.random_tridiagonal(F.col("n_nationkey") + 1, 4)))
    return rows.select("n_nationkey", "i", *(F.round(c, 9).alias(c) for c in ("sub", "diag", "sup")))


@query(f"WITH RECURSIVE {_LCG} SELECT n_nationkey, k, s::BIGINT AS v FROM r WHERE k <= 3")
def v10_random_integers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(vectors.random_integers(F.col("n_nationkey") + 1, F.lit(3))).alias("k", "v")).select("n_nationkey", (F.col("k") + 1).alias("k"), "v")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0.65 THEN (0.65 - x) * 0.35 + 0.75 WHEN x <= 0.8 THEN 0.75 - 4 * (x - 0.65) ELSE (1 - x) / 2 END, 9) AS beta
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 1000) / 1000.0::DOUBLE + 0.00005 AS x FROM lineitem)""")
def v17_momentum_of_all_levels(spark, sf_dir):
    level = F.col("l_partkey") % 1000 / 1000.0 + 0.00005
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(vectors.momentum(level), 9).alias("beta"))


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment AS k, max(c_custkey) AS v FROM customer GROUP BY ALL)
SELECT c_nationkey, max(CASE WHEN k = 'BUILDING' THEN k END) AS stored, 7::BIGINT AS changed, count(*)::INT + (max(CASE WHEN k = 'MACHINERY' THEN 1 ELSE 0 END) = 0)::INT AS n_put, count(*)::INT - max(CASE WHEN k = 'BUILDING' THEN 1 ELSE 0 END)::INT AS n_dropped FROM s GROUP BY c_nationkey""")
def m2_map_changes(spark, sf_dir):
    maps = vectors.map_of(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey", "c_custkey")
    m, put = F.col("m"), vectors.put(F.col("m"), F.lit("MACHINERY"), F.lit(7).cast("long"))
    return maps.select("c_nationkey", vectors.stored_key(m, F.lit("BUILDING")).alias("stored"), vectors.lookup(put, F.lit("MACHINERY")).alias("changed"), F.size(put).alias("n_put"), F.size(vectors.drop_key(m, F.lit("BUILDING"))).alias("n_dropped"))


@query("SELECT n_nationkey, [n_nationkey, 1, 3, n_regionkey]::VARCHAR AS a, 4 AS n FROM nation")
def m11_list_changes(spark, sf_dir):
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    a = vectors.delete_at(vectors.push_back(vectors.push_front(three, F.col("n_nationkey")), F.col("n_regionkey")), 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]")).alias("a"), F.size(a).alias("n"))


@query("WITH b AS (SELECT p_brand, min(p_retailprice) AS low FROM part GROUP BY p_brand) SELECT p.p_brand, round(avg(p_size), 9) AS p_size FROM part p JOIN b ON p.p_brand = b.p_brand AND p_retailprice = low GROUP BY p.p_brand")
def a14_tied_argmin(spark, sf_dir):
    best = linalg.tied_argmin(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ("p_brand",))
    return best.select("p_brand", F.round("p_size", 9).alias("p_size"))


@query("""WITH o AS (SELECT p_brand, max(p_size) AS ratio FROM part GROUP BY p_brand), z AS (SELECT p_brand, p_partkey AS rep, p_size AS ratio FROM part)
SELECT o.p_brand, round((1 + count_if(z.ratio >= o.ratio)) / (1 + count(*)), 9) AS p FROM o JOIN z USING (p_brand) GROUP BY o.p_brand""")
def a17_permutation_p(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = assoc.permutation_p(part.groupBy("p_brand").agg(F.max("p_size").alias("ratio")), part.select("p_brand", F.col("p_partkey").alias("rep"), F.col("p_size").alias("ratio")), ("p_brand",))
    return found.select("p_brand", F.round("p", 9).alias("p"))


# interpolation


@query(f"""WITH {MONTHLY} SELECT grp, t, round(s, 6) AS slope FROM (SELECT grp, t, ((y - y0) / (t - t0) * (t2 - t) + (y2 - y) / (t2 - t) * (t - t0)) / (t2 - t0) AS s FROM
(SELECT grp, t, y, lag(t) OVER w AS t0, lag(y) OVER w AS y0, lead(t) OVER w AS t2, lead(y) OVER w AS y2 FROM k WINDOW w AS (PARTITION BY grp ORDER BY t)) WHERE t0 IS NOT NULL AND t2 IS NOT NULL)""")
def w6_three_point_derivative(spark, sf_dir):
    knots, _ = monthly(spark, sf_dir)
    return interp.three_point_derivative(knots).select("grp", "t", F.round("slope", 6).alias("slope"))


@query(f"WITH {MONTHLY} SELECT grp, t AS t0, round(y, 4) AS area FROM k")
def i4_linear_from_integrals(spark, sf_dir):
    """The linear interpolant made from areas, integrated again over each cell."""
    knots, _ = monthly(spark, sf_dir)
    cells = knots.select("grp", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), F.col("y").alias("area"))
    made = interp.linear_from_integrals(cells)
    over = interp.linear_integral(made, cells.select("grp", F.col("t0").alias("a"), F.col("t1").alias("b")))
    return over.select("grp", F.col("a").alias("t0"), F.round("integral", 4).alias("area"))


@query(f"""WITH {MONTHLY}, x AS (SELECT grp, floor(t / 27)::DOUBLE AS t, sum(y) AS y FROM k GROUP BY ALL), p AS (SELECT grp, list(t ORDER BY t) AS t, list(y ORDER BY t) AS y FROM x GROUP BY grp),
m AS (SELECT *, t[2] - t[1] AS h, t[3] - t[2] AS g, 3 * ((y[3] - y[2]) / (t[3] - t[2]) - (y[2] - y[1]) / (t[2] - t[1])) / (t[3] - t[1]) AS s FROM p)
SELECT grp, u::DOUBLE AS at, round(CASE WHEN u < 1 THEN y[1] + u * h * ((y[2] - y[1]) / h - s * h / 6) + s * pow(u * h, 3) / (6 * h) ELSE y[3] - (2 - u) * g * ((y[3] - y[2]) / g + s * g / 6) + s * pow((2 - u) * g, 3) / (6 * g) END, 6) AS value FROM m, (VALUES (0.25), (0.75), (1.5)) AS x(u)""")
def i6_natural_three_knots(spark, sf_dir):
    """All months in three stretches of 27, one knot each; the natural spline over three knots has a closed form."""
    knots, _ = monthly(spark, sf_dir)
    three = knots.groupBy("grp", F.floor(F.col("t") / 27).cast("double").alias("t")).agg(F.sum("y").alias("y"))
    places = three.select("grp").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (0.25, 0.75, 1.5)))))
    return interp.cubic(three, places, start=(2, 0.0), end=(2, 0.0)).select("grp", F.col("t").alias("at"), F.round("value", 6).alias("value"))


@query("SELECT p_partkey, i::INT AS i, round((p_size + i)::DOUBLE, 6) AS v FROM part, range(0, 5) AS r(i)")
def i38_tridiagonal_solve(spark, sf_dir):
    """A solved system multiplied out again."""
    each = F.sequence(F.lit(0), F.lit(4))
    cells = {"sub": lambda i: i * 0.1, "diag": lambda i: 4.0 + i, "sup": lambda i: 1 - i * 0.2, "rhs": lambda i: (F.col("p_size") + i).cast("double")}
    part = table(spark, sf_dir, "part").select("p_partkey", *(F.transform(each, f).alias(n) for n, f in cells.items()))
    solved = part.withColumn("x", interp.tridiagonal_solve(F.col("sub"), F.col("diag"), F.col("sup"), F.col("rhs")))
    rows = solved.select(F.col("p_partkey").alias("grp"), F.posexplode(F.arrays_zip("sub", "diag", "sup", "x")).alias("i", "z")).select("grp", "i", "z.*")
    return interp.tridiagonal_multiply(rows).select(F.col("grp").alias("p_partkey"), "i", F.round("v", 6).alias("v"))


@query(f"WITH {MONTHLY}, s AS (SELECT grp, min(t) AS low, max(t) AS high FROM k GROUP BY grp) SELECT q.grp, count_if(q.t < low OR q.t > high)::BIGINT AS n_outside FROM q JOIN s ON q.grp = s.grp GROUP BY q.grp")
def i13_count_outside(spark, sf_dir):
    return interp.count_outside(interp.pchip(*monthly(spark, sf_dir)))


_B = "CASE WHEN x < 0 OR x >= 4 THEN 0 WHEN x < 1 THEN x * x * x / 6 WHEN x < 2 THEN (-3 * pow(x - 1, 3) + 3 * pow(x - 1, 2) + 3 * (x - 1) + 1) / 6 WHEN x < 3 THEN (3 * pow(x - 2, 3) - 6 * pow(x - 2, 2) + 4) / 6 ELSE pow(4 - x, 3) / 6 END"


@query(f"SELECT p_partkey, round({_B}, 8) AS b, round(CASE WHEN x >= 0 AND x < 1 THEN 2 * x * x * x / 52 WHEN x >= 3 AND x < 4 THEN 16 * pow(4 - x, 3) / 52 ELSE -1 END, 8) AS beta_ends FROM (SELECT p_partkey, p_size / 10.0::DOUBLE - 0.5 AS x FROM part)")
def i15_basis_on_five_knots(spark, sf_dir):
    x = F.col("p_size") / 10.0 - 0.5
    ends = F.when(((x >= 0) & (x < 1)) | ((x >= 3) & (x < 4)), interp.beta_basis(x, [0.0, 1.0, 2.0, 3.0, 4.0], 2.0, 10.0)).otherwise(-1.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(interp.beta_basis(x, [0.0, 1.0, 2.0, 3.0, 4.0]), 8).alias("b"), F.round(ends, 8).alias("beta_ends"))


@query("""WITH x AS (SELECT p_partkey, (p_size - 1) / 50::DOUBLE AS u, p_size % 7 AS a, p_size % 5 AS b, p_size % 3 AS c, p_size % 2 AS d FROM part)
SELECT p_partkey, round((a * pow(1 - u, 3) + b * (3 * pow(u, 3) - 6 * u * u + 4) + c * (-3 * pow(u, 3) + 3 * u * u + 3 * u + 1) + d * pow(u, 3)) / 6, 6) AS b_uniform,
round(a * pow(1 - u, 3) + 3 * b * u * pow(1 - u, 2) + 3 * c * u * u * (1 - u) + d * pow(u, 3), 6) AS bezier,
round(a * (2 * pow(u, 3) - 3 * u * u + 1) + b * (3 * u * u - 2 * pow(u, 3)) + c * (pow(u, 3) - 2 * u * u + u) + d * (pow(u, 3) - u * u), 6) AS hermite,
round(0.5 * (2 * b + (c - a) * u + (2 * a - 5 * b + 4 * c - d) * u * u + (3 * b - a - 3 * c + d) * pow(u, 3)), 6) AS overhauser, round(0.5 * (2 * b + (c - a) * u + (2 * a - 5 * b + 4 * c - d) * u * u + (3 * b - a - 3 * c + d) * pow(u, 3)), 6) AS overhauser_any,
round(a + u * (-1.5 * a + 2 * b - 0.5 * c) + u * u * (0.5 * a - b + 0.5 * c), 6) AS overhauser_left, round(a + u * (-1.5 * a + 2 * b - 0.5 * c) + u * u * (0.5 * a - b + 0.5 * c), 6) AS overhauser_left_any, round(b + u * (c - a) / 2 + u * u * (0.5 * a - b + 0.5 * c), 6) AS overhauser_right_any, round(b + u * (c - a) / 2 + u * u * (0.5 * a - b + 0.5 * c), 6) AS overhauser_right,
round((a * 16 * pow(1 - u, 3) + b * (16 * u * (u * u - 3 * u + 3) + 8 * (pow(u, 3) - 3 * u * u + 2) + 4 * (pow(u, 3) - 3 * u + 2) + 10 * (2 * pow(u, 3) - 3 * u * u + 1)) + c * (8 * u * u * (3 - u) + 4 * u * (3 - u * u) + 10 * u * u * (3 - 2 * u) + 2 * (1 - pow(u, 3))) + d * 2 * pow(u, 3)) / 52, 6) AS beta_uniform FROM x""")
def i28_basis_matrices(spark, sf_dir):
    u, ys = (F.col("p_size") - 1) / 50.0, [F.col("p_size") % k for k in (7, 5, 3, 2)]
    value = lambda m: F.round(interp.basis_value(u, m, ys[: len(m[0])]), 6) + 0.0
    named = {"overhauser_uniform": "overhauser"}
    columns = [value(m).alias(named.get(k, k)) for k, m in interp.BASIS.items()]
    return table(spark, sf_dir, "part").select("p_partkey", *columns, value(interp.overhauser_basis(0.5, 0.5)).alias("overhauser_any"), value(interp.overhauser_end_basis(1.0)).alias("overhauser_left_any"), value(interp.overhauser_end_basis(1.0, right=True)).alias("overhauser_right_any"), value(interp.beta_uniform_basis(2.0, 10.0)).alias("beta_uniform"))


@query("""WITH x AS (SELECT p_partkey, (p_size - 1) / 50::DOUBLE AS u FROM part) SELECT p_partkey, round(3 * 1.0 * u * pow(1 - u, 2) + 3 * 4.0 * u * u * (1 - u) + 2.0 * pow(u, 3), 8) AS x, round(pow(1 - u, 2) * 5.0 + 2 * u * (1 - u) * -1.0 + u * u * 3.0, 8) AS y FROM x""")
def i29_bezier(spark, sf_dir):
    x = F.col("p_size").cast("double")
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(interp.bezier(F.array(*map(F.lit, (0.0, 1.0, 4.0, 2.0))), 3, x, 1.0, 51.0), 8).alias("x"), F.round(interp.bernstein_approximation(F.array(*map(F.lit, (5.0, -1.0, 3.0))), 2, x, 1.0, 51.0), 8).alias("y"))


@query(f"""WITH {MONTHLY}, a AS (SELECT grp, count(*) AS n, avg(t) AS m, avg(y) AS c0 FROM k GROUP BY grp), p AS (SELECT k.grp, t, y, n, m, c0, t - m AS p1 FROM k JOIN a ON a.grp = k.grp),
b AS (SELECT grp, sum(t * p1 * p1) / sum(p1 * p1) AS b1, sum(p1 * p1) / any_value(n) AS d, sum(p1 * y) / sum(p1 * p1) AS c1 FROM p GROUP BY grp),
r AS (SELECT p.*, b1, d, c1, (t - b1) * p1 - d AS p2 FROM p JOIN b ON b.grp = p.grp), c AS (SELECT grp, any_value(m) AS m, any_value(c0) AS c0, any_value(b1) AS b1, any_value(d) AS d, any_value(c1) AS c1, sum(p2 * y) / sum(p2 * p2) AS c2 FROM r GROUP BY grp)
SELECT q.grp, q.t, round(c0 + c1 * (q.t - m) + c2 * ((q.t - b1) * (q.t - m) - d), 4) AS value FROM q JOIN c ON c.grp = q.grp""")
def i36_quadratic_least_squares(spark, sf_dir):
    knots, q = monthly(spark, sf_dir)
    return interp.least_squares_value(interp.least_squares(knots, 2), q).select("grp", "t", F.round("value", 4).alias("value"))


@query(f"WITH {MONTHLY} SELECT k.grp, round(sqrt(avg(pow(y - f.a - f.b * t, 2))), 5) AS rms FROM k JOIN (SELECT grp, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM k GROUP BY grp) f ON f.grp = k.grp GROUP BY k.grp")
def a3_rms_of_a_fit(spark, sf_dir):
    knots, _ = monthly(spark, sf_dir)
    return interp.least_squares(knots, 1).select("grp", F.round("rms", 5).alias("rms"))


# matrices


def _nation_cells(spark, sf_dir) -> DataFrame:
    """Cells region x (nation modulo 5)."""
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").cast("long").alias("i"), (F.col("n_nationkey") % 5).cast("long").alias("j")).agg(F.sum(F.col("n_nationkey") + 1).cast("double").alias("v"))


_NATION_CELLS = "a AS (SELECT n_regionkey::BIGINT AS i, (n_nationkey % 5)::BIGINT AS j, sum(n_nationkey + 1)::DOUBLE AS v FROM nation GROUP BY ALL)"


@query(f"WITH {_NATION_CELLS} SELECT j AS i, 4 - i AS j, v FROM a")
def l22_quarter_turn(spark, sf_dir):
    return linalg.rotate(_nation_cells(spark, sf_dir), 5)


@query(f"WITH {_NATION_CELLS} SELECT i, j, 10 - (v + 2) AS v FROM a WHERE i >= j AND NOT (i = 2 AND j = 1) UNION ALL SELECT 2, 1, 10 - 101.0")
def l10_shifted_lower_triangle(spark, sf_dir):
    a = linalg.put(_nation_cells(spark, sf_dir), 2, 1, 99.0)
    return linalg.lower(linalg.scalar_minus(10.0, linalg.shift(a, 2.0)))


@query(f"WITH {_NATION_CELLS} SELECT (SELECT max(i) + 1 FROM a) AS height, (SELECT max(j) + 1 FROM a) AS width, (SELECT sum(v) FROM a WHERE i <= j) AS upper, 12.0::DOUBLE AS filled")
def l3_dims_and_triangle(spark, sf_dir):
    a = _nation_cells(spark, sf_dir)
    one = lambda df: df.withColumn("k", F.lit(1))
    parts = [linalg.dims(a), linalg.upper(a).agg(F.sum("v").alias("upper")), linalg.constant(spark, 3, 4, 1.0).agg(F.sum("v").alias("filled"))]
    return one(parts[0]).join(one(parts[1]), "k").join(one(parts[2]), "k").drop("k")


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::BIGINT - 1 AS j FROM embeddings) SELECT vec_id AS i, j, round(v, 6) + 0.0 AS v FROM e")
def l1_matrix_from_rows(spark, sf_dir):
    return linalg.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("""WITH x AS (SELECT l_suppkey AS r, ascii(l_returnflag)::BIGINT AS c, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL), y AS (SELECT * FROM x)
SELECT x.r AS i, y.r AS j, sum(x.v * y.v) AS v FROM x JOIN y ON x.c = y.c GROUP BY ALL""")
def l12_gram_of_rows(spark, sf_dir):
    """Counts by supplier and flag over all line items, times their transpose."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.ascii("l_returnflag").cast("long").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return linalg.gram_rows(a)


_TWO = ["l_quantity", "l_tax"]
_PAIR = "c AS (SELECT l_returnflag AS m, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 100) AS b, var_samp(l_tax * 100) AS d FROM lineitem GROUP BY l_returnflag)"


def _pair(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_tax") * 100).alias("l_tax"))
    return linalg.covariance(li, _TWO, ("l_returnflag",)).withColumnRenamed("l_returnflag", "m")


@query(f"WITH {_PAIR} SELECT m, 0::BIGINT AS i, 0::BIGINT AS j, round(sqrt(a), 6) AS v FROM c UNION ALL SELECT m, 1, 0, round(b / sqrt(a), 6) + 0.0 FROM c UNION ALL SELECT m, 1, 1, round(sqrt(d - b * b / a), 6) FROM c")
def l16_cholesky(spark, sf_dir):
    return linalg.cholesky(_pair(spark, sf_dir)).select("m", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {_PAIR} SELECT m, 0::BIGINT AS i, 0::BIGINT AS j, round(1 / sqrt(a), 6) AS v FROM c UNION ALL SELECT m, 1, 0, round(-b / a / sqrt(d - b * b / a), 6) + 0.0 FROM c UNION ALL SELECT m, 1, 1, round(1 / sqrt(d - b * b / a), 6) FROM c")
def l18_triangular_inverse(spark, sf_dir):
    return linalg.lower(linalg.inverse(linalg.cholesky(_pair(spark, sf_dir)))).select("m", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {_PAIR} SELECT m, k, round((a + d) / 2 + (2 * k - 1) * sqrt(pow((a - d) / 2, 2) + b * b), 6) AS value FROM c, (VALUES (0::BIGINT), (1::BIGINT)) AS x(k)")
def l19_eigenvalues(spark, sf_dir):
    return linalg.eigen(_pair(spark, sf_dir)).select("m", "k", F.round("value", 6).alias("value"))


@query(f"WITH {_PAIR} SELECT m, round(((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b)) / ((a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b)), 5) AS condition FROM c")
def a5_condition_number(spark, sf_dir):
    return linalg.condition_number(linalg.eigen(_pair(spark, sf_dir))).select("m", F.round("condition", 5).alias("condition"))


def _shrunk(level: str, where: str = "TRUE") -> str:
    """SQL of the two-variable graphical lasso: the covariance is shrunk toward 0, the diagonal raised, the matrix inverted."""
    return f"""x AS (SELECT m, a + {level} AS a, sign(b) * greatest(abs(b) - {level}, 0) AS b, d + {level} AS d FROM c WHERE {where}), y AS (SELECT *, a * d - b * b AS det FROM x)"""


@query("WITH " + _PAIR + ", " + _shrunk("0.05") + " " + " UNION ALL ".join(f"SELECT '{how}' AS method, m, {i}::BIGINT AS i, {j}::BIGINT AS j, round({v} / det, 5) + 0.0 AS v FROM y" for how in glasso.METHODS for i, j, v in ((0, 0, "d"), (0, 1, "-b"), (1, 0, "-b"), (1, 1, "a"))))
def g18_two_variables_by_each_method(spark, sf_dir):
    cells, out = _pair(spark, sf_dir), None
    for how in glasso.METHODS:
        one = glasso.graphical_lasso(cells, 0.05, method=how, tol=1e-10).select(F.lit(how).alias("method"), "m", "i", "j", (F.round("v", 5) + 0.0).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_returnflag AS m, 0::BIGINT AS i, 0::BIGINT AS j, round(1 / (var_samp(l_quantity) + 0.5), 8) AS v FROM lineitem GROUP BY l_returnflag")
def g18_one_variable(spark, sf_dir):
    cells = linalg.covariance(table(spark, sf_dir, "lineitem"), ["l_quantity"], ("l_returnflag",)).withColumnRenamed("l_returnflag", "m")
    return glasso.graphical_lasso(cells, 0.5).select("m", "i", "j", F.round("v", 8).alias("v"))


def _logdet_sql(names: list[str]) -> str:
    """SQL of the log-determinants of covariance matrices by elimination of one variable after the other."""
    n = len(names)
    name = lambda k, i, j: f"s{k}_{min(i, j)}_{max(i, j)}"
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    steps = ["z0 AS (SELECT l_returnflag AS m, " + ", ".join(f"covar_samp({names[i]}, {names[j]}) AS {name(0, i, j)}" for i, j in pairs) + " FROM lineitem GROUP BY l_returnflag)"]
    for k in range(1, n):
        some = [f"{name(k - 1, i, j)} - {name(k - 1, k - 1, i)} * {name(k - 1, k - 1, j)} / {name(k - 1, k - 1, k - 1)} AS {name(k, i, j)}" for i, j in pairs if i >= k]
        steps.append(f"z{k} AS (SELECT *, {', '.join(some)} FROM z{k - 1})")
    return f"WITH {', '.join(steps)} SELECT m, round({' + '.join(f'ln({name(k, k, k)})' for k in range(n))}, 6) AS logdet FROM z{n - 1}"


@query(_logdet_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def l20_log_determinant(spark, sf_dir):
    cells = linalg.covariance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ("l_returnflag",)).withColumnRenamed("l_returnflag", "m")
    return linalg.log_determinant(linalg.cholesky(cells)).select("m", F.round("logdet", 6).alias("logdet"))


@query(f"""WITH RECURSIVE {MONTHLY}, {BRACKET}, z AS (SELECT k.grp, k.i, k.t, k.y, n, k.t - lag(k.t) OVER w AS h0, lead(k.t) OVER w - k.t AS h1, (k.y - lag(k.y) OVER w) / (k.t - lag(k.t) OVER w) AS d0, (lead(k.y) OVER w - k.y) / (lead(k.t) OVER w - k.t) AS d1 FROM k JOIN c ON c.grp = k.grp WINDOW w AS (PARTITION BY k.grp ORDER BY k.t)),
e AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN i = n THEN -1 ELSE h0 / 6 END AS sub, CASE WHEN i = 1 OR i = n THEN 1 ELSE (h0 + h1) / 3 END AS diag, CASE WHEN i = 1 THEN -1 WHEN i = n THEN 0 ELSE h1 / 6 END AS sup, CASE WHEN i = 1 OR i = n THEN 0 ELSE d1 - d0 END AS rhs FROM z),
f AS (SELECT grp, i, sup / diag AS p, rhs / diag AS r FROM e WHERE i = 1 UNION ALL SELECT e.grp, e.i, sup / (diag - sub * f.p), (rhs - sub * f.r) / (diag - sub * f.p) FROM f JOIN e ON e.grp = f.grp AND e.i = f.i + 1),
g AS (SELECT f.grp, f.i, f.r AS s FROM f JOIN c ON c.grp = f.grp AND c.n = f.i UNION ALL SELECT f.grp, f.i, f.r - f.p * g.s FROM g JOIN f ON f.grp = g.grp AND f.i = g.i - 1),
v AS (SELECT b.grp, b.t, b.t - x.t AS d, y.t - x.t AS h, x.y AS y0, y.y AS y1, gx.s AS p0, gy.s AS p1 FROM b JOIN k x ON x.grp = b.grp AND x.i = b.i JOIN k y ON y.grp = b.grp AND y.i = b.i + 1 JOIN g gx ON gx.grp = b.grp AND gx.i = b.i JOIN g gy ON gy.grp = b.grp AND gy.i = b.i + 1)
SELECT grp, t, round(y0 + d * ((y1 - y0) / h - (p1 / 6 + p0 / 3) * h + d * (p0 / 2 + d * (p1 - p0) / h / 6)), 4) AS value, round((y1 - y0) / h - (p1 / 6 + p0 / 3) * h + d * (p0 + d * (p1 - p0) / h / 2), 4) AS slope, round(p0 + d * (p1 - p0) / h, 4) AS second FROM v""")
def i7_cubic_value_and_derivatives(spark, sf_dir):
    return interp.cubic(*monthly(spark, sf_dir)).select("grp", "t", F.round("value", 4).alias("value"), F.round("slope", 4).alias("slope"), F.round("second", 4).alias("second"))


@query(f"WITH {_PAIR}, y AS (SELECT *, a * d - b * b AS det FROM c) " + " UNION ALL ".join(f"SELECT m, {i}::BIGINT AS i, {j}::BIGINT AS j, round({v} / det, 5) + 0.0 AS v1, round({v} / det, 5) + 0.0 AS v2 FROM y" for i, j, v in ((0, 0, "d"), (0, 1, "-b"), (1, 0, "-b"), (1, 1, "a"))))
def g6_pair_of_equal_samples(spark, sf_dir):
    """Two equal samples: nothing is penalised, both precisions are the inverse."""
    cells = _pair(spark, sf_dir)
    found = glasso.paired_lasso(cells, cells, 0.3, tol=1e-10)
    return found.select("m", "i", "j", *((F.round(v, 5) + 0.0).alias(v) for v in ("v1", "v2")))


@query(f"WITH {MONTHLY}, {BRACKET}, {FOUR}, o AS (SELECT grp, t, CASE WHEN t0 IS NULL THEN {PARABOLA(1, 2, 3)} WHEN t3 IS NULL THEN {PARABOLA(0, 1, 2)} ELSE (1 - u) * {PARABOLA(0, 1, 2)} + u * {PARABOLA(1, 2, 3)} END AS v FROM r) SELECT grp, t, round(v, 5) AS first, round(1 - 2 * v, 5) AS second FROM o")
def i20_overhauser_vectors(spark, sf_dir):
    knots, q = monthly(spark, sf_dir)
    found = interp.overhauser_vectors(knots.select("grp", "t", F.array("y", 1 - 2 * F.col("y")).alias("ys")), q)
    return found.select("grp", "t", F.round(F.get("values", F.lit(0)), 5).alias("first"), F.round(F.get("values", F.lit(1)), 5).alias("second"))


@query("SELECT l_returnflag, l_linestatus, count_if(l_discount = 0.05)::BIGINT AS n_equal, max(abs(l_tax - 0.04)) AS worst, round(sum(l_tax * l_discount) / sqrt(sum(l_tax * l_tax)) / sqrt(sum(l_discount * l_discount)), 8) AS cosine FROM lineitem GROUP BY ALL")
def a2_cosine_and_counts(spark, sf_dir):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    cosine = F.sum(tax * discount) / F.sqrt(F.sum(tax * tax)) / F.sqrt(F.sum(discount * discount))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(discount == 0.05).alias("n_equal"), F.max(F.abs(tax - 0.04)).alias("worst"), F.round(cosine, 8).alias("cosine"))


@query(f"""WITH {EV}, {BINS}, u AS (SELECT DISTINCT user_id, user_id % 3 AS dosage FROM ev WHERE user_id % 7 > 0),
c AS (SELECT user_id, bin, count(*) AS n FROM bins JOIN ev ON minute >= start AND minute < start + {SIZE} GROUP BY ALL),
full_grid AS (SELECT b.bin, u.dosage::DOUBLE AS x, 2 * coalesce(n, 0)::DOUBLE AS y FROM bins b CROSS JOIN u LEFT JOIN c ON c.bin = b.bin AND c.user_id = u.user_id),
s AS (SELECT bin, avg(y) AS mean, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(y * y) - sum(y) * sum(y) / count(*) AS syy, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy FROM full_grid GROUP BY bin),
r AS (SELECT bin, mean, CASE WHEN sxx <= 1e-12 OR syy <= 1e-12 THEN 1.0 ELSE sqrt(syy / (syy - sxy * sxy / sxx)) END AS ratio, CASE WHEN sxx > 1e-12 THEN abs(sxy / sxx) ELSE 0 END AS effect FROM s),
f AS (SELECT * FROM r, (VALUES (1.0101::DOUBLE), (1.0203::DOUBLE)) AS a(l1), (VALUES (0.0507::DOUBLE), (0.1009::DOUBLE)) AS b(l2) WHERE ratio >= l1 AND effect >= l2),
g AS (SELECT *, bin - row_number() OVER (PARTITION BY l1, l2 ORDER BY bin) AS island FROM f)
SELECT l1, l2, '7' AS chrom, (min(bin) * {SPACING})::BIGINT AS start, (max(bin) * {SPACING} + {SPACING})::BIGINT AS "end", count(*) AS n, round(max(ratio), 5) AS ratio, round(max(effect), 5) AS threshold, round(avg(mean), 5) AS mean FROM g GROUP BY l1, l2, island""")
def t1_segment_scan(spark, sf_dir):
    """The tool's scan over two by two floors: users as samples, their events as cut sites."""
    ev = events(spark, sf_dir)
    genotypes = ev.select(F.lit("rs1").alias("rsid"), F.col("user_id").cast("string").alias("sample"), F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 3).alias("dosage")).distinct()
    cuts = ev.select(F.col("user_id").cast("string").alias("sample"), F.lit("7").alias("chr"), F.col("minute").alias("start"), F.col("minute").alias("end"))
    _, o = segment_scan.parse(f"-rsid:rs1 -chr:7 -minbp:0 -maxbp:{HIGH} -binspacing:{SPACING} -binsize:{SIZE} -l1:1.0101,1.0203 -l2:0.0507,0.1009 -seg".split())
    found = segment_scan.find_segments(genotypes, cuts, o)
    return found.select("l1", "l2", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n", *(F.round(c, 5).alias(c) for c in ("ratio", "threshold", "mean")))
