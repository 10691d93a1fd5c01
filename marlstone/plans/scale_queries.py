"""Queries of the operators that cut long groups, intervals and matrices into parts, with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import expr, vectors
from marlstone.operators import asof, assoc, banded, interp, intervals, tiles
from marlstone.plans.catalogue import COUNTS, EV, MONTHLY, QUERIES, SPACING, events, monthly, query, table
from marlstone.plans.folders import shared_folder
from marlstone.sources import annotated, single_file, text

# one group of all events, in ranges


def _all_purchases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Knots: the largest purchase of each minute, all users together; queries: the minutes of clicks and some outside."""
    ev = events(spark, sf_dir).select(F.lit("all").alias("grp"), F.col("minute").cast("double").alias("t"), "event_type", "value")
    knots = ev.where("event_type = 'purchase'").groupBy("grp", "t").agg(F.max("value").alias("y"))
    return knots, ev.where("event_type in ('click', 'view')").select("grp", "t").distinct()


_ALL = f"""{EV}, k AS (SELECT 'all' AS grp, minute::DOUBLE AS t, max(value) AS y, row_number() OVER (ORDER BY minute) AS i FROM ev WHERE event_type = 'purchase' GROUP BY minute),
q AS (SELECT DISTINCT 'all' AS grp, minute::DOUBLE AS t FROM ev WHERE event_type IN ('click', 'view'))"""
#: Rows of a range, small enough for several ranges on the smallest tables.
RANGE = 500


@query("""WITH p AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ts)
SELECT event_id, e.ts, p.ts AS ts_right, p.value AS last_purchase FROM events e ASOF LEFT JOIN p ON e.ts >= p.ts""")
def j5_asof_one_group(spark, sf_dir):
    """The last purchase before every event, all events being one group."""
    ev = table(spark, sf_dir, "events").select(F.lit(1).alias("grp"), "ts", "event_id", "event_type", "value")
    right = ev.where("event_type = 'purchase'").groupBy("grp", "ts").agg(F.max("value").alias("last_purchase"))
    return asof.asof(ev.select("grp", "ts", "event_id"), right, "grp", "ts", ("last_purchase",), size=RANGE).drop("grp")


@query(f"""WITH {_ALL}, f AS (SELECT q.t, k.y FROM q ASOF LEFT JOIN k ON q.t <= k.t)
SELECT t, coalesce(y, (SELECT arg_max(y, t) FROM k)) AS value FROM f""")
def i1_step_one_group(spark, sf_dir):
    return asof.step_value(*_all_purchases(spark, sf_dir), size=RANGE).drop("grp")


@query(f"""WITH {_ALL}, b AS (SELECT q.t, greatest(1, least((SELECT count(*) FROM k) - 1, coalesce(k.i, 1))) AS i FROM (SELECT t + 1::DOUBLE / 3 AS t FROM q) q ASOF LEFT JOIN k ON q.t >= k.t)
SELECT b.t, round(k0.y + (b.t - k0.t) * ((k1.y - k0.y) / (k1.t - k0.t)), 6) AS value FROM b JOIN k k0 ON k0.i = b.i JOIN k k1 ON k1.i = b.i + 1""")
def i2_linear_one_group(spark, sf_dir):
    """The value a third of a minute after every click and view."""
    knots, q = _all_purchases(spark, sf_dir)
    return interp.linear(knots, q.withColumn("t", F.col("t") + 1.0 / 3), size=RANGE).select("t", F.round("value", 6).alias("value"))


@query(f"""WITH {_ALL}, a AS (SELECT *, coalesce(sum((t - pt) * (y + py) / 2) OVER (ORDER BY t), 0) AS area FROM (SELECT *, lag(t) OVER (ORDER BY t) AS pt, lag(y) OVER (ORDER BY t) AS py FROM k)),
b AS (SELECT q.t, greatest(1, least((SELECT count(*) FROM k) - 1, coalesce(k.i, 1))) AS i FROM q ASOF LEFT JOIN k ON q.t >= k.t),
f AS (SELECT b.t, k0.area + (b.t - k0.t) * k0.y + (k1.y - k0.y) / (k1.t - k0.t) * (b.t - k0.t) * (b.t - k0.t) / 2 AS upto FROM b JOIN a k0 ON k0.i = b.i JOIN k k1 ON k1.i = b.i + 1),
z AS (SELECT (1000 - k0.t) * k0.y + (k1.y - k0.y) / (k1.t - k0.t) * (1000 - k0.t) * (1000 - k0.t) / 2 + k0.area AS upto FROM a k0 JOIN k k1 ON k1.i = k0.i + 1 WHERE k0.t <= 1000 AND k1.t > 1000)
SELECT t AS b, round(f.upto - z.upto, 2) AS integral FROM f, z""")
def i3_integral_one_group(spark, sf_dir):
    """The area under the purchases from minute 1000 to every click and view."""
    knots, q = _all_purchases(spark, sf_dir)
    limits = q.select("grp", F.lit(1000.0).alias("a"), F.col("t").alias("b"))
    return interp.linear_integral(knots, limits, size=RANGE).select("b", F.round("integral", 2).alias("integral"))


# intervals against intervals

_SHIPPED = "a AS (SELECT s_nationkey AS nation, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS a0, a0 + l_quantity::BIGINT AS a1, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"
_OPEN = "b AS (SELECT c_nationkey AS nation, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS b0, b0 + 1 + (o_totalprice / 1000)::BIGINT % 7 * ((o_orderkey % 90 = 0)::INT * 99 + 1) AS b1, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey)"


def _shipped_and_open(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Shipments by the supplier's nation, some days each, and open orders by the customer's nation, of which some are open for long."""
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1995-01-01").cast("date")).cast("long")
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    a = items.select(F.col("s_nationkey").alias("nation"), day("l_shipdate").alias("a0"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("a1"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    days = 1 + F.rint(F.col("o_totalprice") / 1000).cast("long") % 7 * F.when(F.col("o_orderkey") % 90 == 0, 100).otherwise(1)
    b = orders.select(F.col("c_nationkey").alias("nation"), day("o_orderdate").alias("b0"), (day("o_orderdate") + days).alias("b1"), "o_orderpriority")
    return a, b


@query(f"""WITH {_SHIPPED}, {_OPEN} SELECT a.nation, l_returnflag, o_orderpriority, count(*) AS n, sum(least(a1, b1) - greatest(a0, b0))::BIGINT AS days
FROM a JOIN b ON a.nation = b.nation AND a0 < b1 AND b0 < a1 GROUP BY ALL""")
def j2_overlapping_intervals(spark, sf_dir):
    """Shipments from a nation and open orders of it that overlap: their number and the days that both last."""
    a, b = _shipped_and_open(spark, sf_dir)
    totals = intervals.overlap_totals(a, b, ("a0", "a1"), ("b0", "b1"), ("nation",), ("l_returnflag",), ("o_orderpriority",), size=RANGE)
    return totals.withColumnRenamed("length", "days")


@query(f"""WITH {_SHIPPED}, {_OPEN}, x AS (SELECT *, row_number() OVER () AS r FROM a)
SELECT nation, l_returnflag, sum(n)::BIGINT AS n FROM (SELECT x.nation, l_returnflag, count(b.b0) AS n FROM x LEFT JOIN b ON x.nation = b.nation AND a0 < b1 AND b0 < a1 GROUP BY x.r, x.nation, l_returnflag) GROUP BY ALL""")
def j2_overlap_counts(spark, sf_dir):
    """Each shipment's number of overlapping open orders, from ranks instead of pairs, summed by nation and flag."""
    a, b = _shipped_and_open(spark, sf_dir)
    counts = intervals.overlap_counts(a, b, ("a0", "a1"), ("b0", "b1"), "nation", size=RANGE)
    return counts.groupBy("nation", "l_returnflag").agg(F.sum("n").alias("n"))


# matrices in tiles


@query("""WITH x AS (SELECT o_orderkey AS r, o_custkey % 4 AS c, (o_orderkey % 9)::DOUBLE AS v FROM orders)
SELECT x.r AS i, sum(x.v * y.v) AS total, max(x.v * y.v) AS largest FROM x JOIN x y ON x.c = y.c GROUP BY x.r""")
def l12_gram_of_all_rows(spark, sf_dir):
    """Sum and largest cell of every row of A A^T over all orders, from tiles over the distinct rows."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 4).alias("j"), (F.col("o_orderkey") % 9).cast("double").alias("v"))
    return tiles.gram_summary(a, rows=512, cols=4)


@query("""WITH a AS (SELECT l_suppkey AS i, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::BIGINT AS k, o_custkey % 50 AS j, count(*)::DOUBLE AS v FROM orders GROUP BY ALL)
SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.k = b.k GROUP BY ALL""")
def l11_tiled_product(spark, sf_dir):
    """Quantities by supplier and month times orders by month and customer class."""
    month = lambda c: ((F.year(c) - 1995) * 12 + F.month(c) - 1).cast("long")
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), month("l_shipdate").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = table(spark, sf_dir, "orders").groupBy(month("o_orderdate").alias("i"), (F.col("o_custkey") % 50).alias("j")).agg(F.count("*").cast("double").alias("v"))
    return tiles.matmul(a, b, rows=32, cols=16).where("v != 0")


# systems and fits over long groups


@query("SELECT event_id, round(value, 5) + 0.0 AS rhs FROM events")
def i38_blocked_tridiagonal(spark, sf_dir):
    """A system over all events whose diagonal is far from dominant, solved in blocks and multiplied out again."""
    ev = table(spark, sf_dir, "events").select(F.lit(1).alias("grp"), F.col("event_id"), "value")
    first = ev.agg(F.min("event_id")).first()[0]
    i = F.col("event_id") - first
    system = ev.select("grp", i.alias("i"), F.lit(-1.0).alias("sub"), F.when(i % 5 == 0, 0.0).otherwise(0.3).alias("diag"), F.lit(1.0).alias("sup"), F.col("value").alias("rhs"))
    found = banded.solve(system, block=700)
    side = lambda k, c: found.select("grp", (F.col("i") + k).alias("i"), F.col("x").alias(c))
    joined = system.join(side(0, "x"), ["grp", "i"], "left").join(side(1, "before"), ["grp", "i"], "left").join(side(-1, "behind"), ["grp", "i"], "left")
    rhs = F.coalesce(F.col("sub") * F.col("before"), F.lit(0.0)) + F.col("diag") * F.col("x") + F.coalesce(F.col("sup") * F.col("behind"), F.lit(0.0))
    return joined.select((F.col("i") + first).alias("event_id"), (F.round(rhs, 5) + 0.0).alias("rhs"))


@query("""WITH x AS (SELECT l_returnflag AS grp, l_discount * 10 AS t, l_quantity + pow(l_discount * 10, 3) AS y FROM lineitem),
m AS (SELECT grp, t, count(*) AS n, avg(y) AS y FROM x GROUP BY ALL),
s AS (SELECT grp, sum(n) AS s0, sum(n * t) AS s1, sum(n * t ** 2) AS s2, sum(n * t ** 3) AS s3, sum(n * t ** 4) AS s4, sum(n * t ** 5) AS s5, sum(n * t ** 6) AS s6, sum(n * y) AS r0, sum(n * y * t) AS r1, sum(n * y * t ** 2) AS r2, sum(n * y * t ** 3) AS r3 FROM m GROUP BY grp),
e1 AS (SELECT grp, s1 / s0 AS a1, s2 / s0 AS a2, s3 / s0 AS a3, r0 / s0 AS a4, s2 - s1 * s1 / s0 AS b1, s3 - s1 * s2 / s0 AS b2, s4 - s1 * s3 / s0 AS b3, r1 - s1 * r0 / s0 AS b4,
  s3 - s2 * s1 / s0 AS c1, s4 - s2 * s2 / s0 AS c2, s5 - s2 * s3 / s0 AS c3, r2 - s2 * r0 / s0 AS c4, s4 - s3 * s1 / s0 AS d1, s5 - s3 * s2 / s0 AS d2, s6 - s3 * s3 / s0 AS d3, r3 - s3 * r0 / s0 AS d4 FROM s),
e2 AS (SELECT *, c2 - c1 * b2 / b1 AS f2, c3 - c1 * b3 / b1 AS f3, c4 - c1 * b4 / b1 AS f4, d2 - d1 * b2 / b1 AS g2, d3 - d1 * b3 / b1 AS g3, d4 - d1 * b4 / b1 AS g4 FROM e1),
e3 AS (SELECT *, (g4 - g2 * f4 / f2) / (g3 - g2 * f3 / f2) AS z3 FROM e2), e4 AS (SELECT *, (f4 - f3 * z3) / f2 AS z2 FROM e3), e5 AS (SELECT *, (b4 - b2 * z2 - b3 * z3) / b1 AS z1 FROM e4)
SELECT m.grp, m.t, round(a4 - a1 * z1 - a2 * z2 - a3 * z3 + t * (z1 + t * (z2 + t * z3)), 4) AS value FROM m JOIN e5 ON e5.grp = m.grp""")
def i36_cubic_least_squares(spark, sf_dir):
    """Quantity over discount by flag, degree 3, over all line items: three groups of a third of the rows each."""
    t = F.col("l_discount") * 10
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), t.alias("t"), (F.col("l_quantity") + t * t * t).alias("y"))
    return interp.least_squares_value(interp.least_squares(points, 3), points.select("grp", "t").distinct()).select("grp", "t", F.round("value", 4).alias("value"))


@query(f"WITH {MONTHLY} SELECT grp, t AS t0, round(y, 4) AS area FROM k")
def i4_areas_of_all_months(spark, sf_dir):
    """The linear interpolant made from every month's area, integrated again over each month."""
    knots, _ = monthly(spark, sf_dir)
    cells = knots.select("grp", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), F.col("y").alias("area"))
    made = interp.linear_from_integrals(cells, size=30)
    over = interp.linear_integral(made, cells.select("grp", F.col("t0").alias("a"), F.col("t1").alias("b")))
    return over.select("grp", F.col("a").alias("t0"), F.round("integral", 4).alias("area"))


# generators and permutations by number


@query("""WITH RECURSIVE p(i, c) AS (SELECT 0, 16807::BIGINT UNION ALL SELECT i + 1, (c * c) % 2147483647 FROM p WHERE i < 39), f AS (SELECT list(c ORDER BY i) AS c FROM p)
SELECT l_orderkey, l_linenumber, list_reduce(list_transform(range(0, 40), lambda i: CASE WHEN ((l_orderkey * 8 + l_linenumber) >> i) & 1 = 1 THEN c[i + 1] ELSE 1 END), lambda a, b: (a * b) % 2147483647)::DOUBLE * 4.656612875e-10 AS u FROM lineitem, f""")
def v7_jump_ahead(spark, sf_dir):
    """One sequence over all line items, the k-th number for line item k, none made from the one before."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (vectors.lcg_state(F.lit(1), k) * vectors.LCG_SCALE).alias("u"))


def _mixed_sql(x: str, key: str) -> str:
    return f"(((((({x}) * 16807 + ({key})) % 2147483647) * 48271 + ({key})) % 2147483647) * 69621 % 2147483647)"


_PARTNER = f"(({_mixed_sql('key + r * 7919', 'r + 1')} % n) - x + n) % n"


@query(f"""WITH s AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
e AS (SELECT *, (rep + 1000003) % 2147483647 AS key FROM s, range(1, 5) AS t(rep)),
m AS (SELECT rep, c_custkey, list_reduce(list_prepend(i::BIGINT, range(0, 48)), lambda x, r: CASE WHEN ({_mixed_sql(f"greatest(x, {_PARTNER})", "key + r * 104729")} >> 11) & 1 = 1 THEN {_PARTNER} ELSE x END) AS j FROM e)
SELECT m.rep::INTEGER AS rep, m.c_custkey, s.c_nationkey FROM m JOIN s ON s.i = m.j""")
def a17_keyed_permutation(spark, sf_dir):
    """Four permutations of all customers' nations, each value found by its number."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first = customers.agg(F.min("c_custkey")).first()[0]
    return assoc.permuted_by_key(customers.withColumn("number", F.col("c_custkey") - first), 4, sample="c_custkey", value="c_nationkey").select("rep", "c_custkey", "c_nationkey")


# tables as text


@query("""WITH c AS (SELECT vec_id, i AS component, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) AS t(i))
SELECT vec_id, component, round(v, 6) + 0.0 AS v FROM c WHERE component IN (SELECT component FROM c WHERE vec_id = 3 AND v > 0) AND component IN (SELECT component FROM c WHERE vec_id = 5 AND v <= 0.05)""")
def f2_columns_by_mask(spark, sf_dir):
    """The components, as columns, that are positive in one vector and small in another, of all vectors."""
    e = table(spark, sf_dir, "embeddings")
    wide = e.select(F.concat(F.lit("V_"), F.col("vec_id")).alias("vec"), *(F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(64)))
    kept = expr.columns_where(wide, "vec", "V_3 > 0 AND V_5 <= 0.05")
    long = kept.unpivot(["vec"], [c for c in kept.columns if c != "vec"], "component", "v")
    return long.select(F.substring("vec", 3, 20).cast("long").alias("vec_id"), F.substring("component", 2, 9).cast("long").alias("component"), (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {COUNTS}, kept AS (SELECT * FROM counts WHERE 100 * n * (SELECT count(*) FROM counts) >= 125 * (SELECT sum(n) FROM counts)),
g AS (SELECT *, bin - row_number() OVER (ORDER BY bin) AS island FROM kept), w AS (SELECT min(start) AS a, max(start) + {SPACING} AS b, count(*) AS n, max(n) AS ratio FROM g GROUP BY island)
SELECT row_number() OVER (ORDER BY ratio DESC, a) - 1 AS line, a::VARCHAR AS loc_start, b::VARCHAR AS loc_end, n::VARCHAR AS marks, ratio::VARCHAR AS ratio FROM w""")
def s10_segment_file(spark, sf_dir):
    """The segments of all events written as one file, and its lines."""
    prefix = f"{shared_folder(spark)}/scan"
    text.save_segment_file(QUERIES["w3_segments"](spark, sf_dir).withColumn("chrom", F.lit("all")), prefix)
    rows = annotated.read_annotated(spark, f"{prefix}.seg").body()
    return rows.select(F.col("row").alias("line"), *(text.cell(F.col("fields"), k).alias(c) for k, c in ((2, "loc_start"), (3, "loc_end"), (4, "marks"), (5, "ratio"))))


@query("""WITH c AS (SELECT p_brand AS brand, p_size % 5 AS k, count(*) AS n, sum(p_retailprice) AS total FROM part GROUP BY ALL), o AS (SELECT brand, row_number() OVER (ORDER BY brand DESC) - 1 AS rank FROM (SELECT DISTINCT brand FROM c))
SELECT o.rank, c.brand, 'class ' || k AS class, 'sizes ' || k || ' of 5' AS about, n::DOUBLE AS v FROM c JOIN o ON o.brand = c.brand WHERE n > 12""")
def s11_annotated_table(spark, sf_dir):
    """Counts by brand and size class as an annotated text table: written as one file, read, and joined by its keys and annotations."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(*(F.count_if(F.col("p_size") % 5 == k).alias(f"n{k}") for k in range(5)))
    shown = [F.when(F.col(f"n{k}") > 12, F.col(f"n{k}").cast("string")).otherwise("few") for k in range(5)]
    lines = counts.orderBy(F.desc("p_brand")).select(F.concat_ws("\t", F.lit("row"), "p_brand", *shown).alias("line"))
    header = "\n".join("\t".join(x) for x in (["kind", "brand", *(f"class {k}" for k in range(5))], ["", "", *(f"sizes {k} of 5" for k in range(5))]))
    path = f"{shared_folder(spark)}/counts.txt"
    single_file.save_lines(lines, path, header)
    read = annotated.read_annotated(spark, path, rows=2, cols=2)
    names = read.header().select((F.col("column") - 2).cast("long").alias("j"), F.col("name").alias("class"))
    about = read.column_annotations().select((F.col("column") - 2).cast("long").alias("j"), F.col("text").alias("about"))
    keys = read.index("brand").select("row", F.col("key").alias("brand"))
    cells = read.scores().join(names, "j").join(about, "j").join(keys, F.col("i") == F.col("row"))
    return cells.select(F.col("i").alias("rank"), "brand", "class", "about", "v")
