"""Query catalogue: name -> callable (spark, sf_dir) and name -> DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr, vectors
from marlstone.operators import asof, assoc, glasso, interp, intervals, linalg
from marlstone.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HIGH, SPACING, SIZE = 43_200, 10, 150
TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_of(ts: Column) -> Column:
    """Minutes from 2024-01-01 of a timestamp without time zone."""
    return (F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date")) * 1440 + F.hour(ts) * 60 + F.minute(ts)).cast("long")


def month_of(ts: Column) -> Column:
    """Months from January 1995."""
    return ((F.year(ts) - 1995) * 12 + F.month(ts) - 1).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", minute_of(F.col("ts")).alias("minute"))


MINUTE = "(date_diff('day', DATE '2024-01-01', ts::DATE) * 1440 + hour(ts) * 60 + minute(ts))"
MONTH = "((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)"
EV = f"ev AS (SELECT event_id, user_id, event_type, value, {MINUTE} AS minute FROM events)"
BINS = f"bins AS (SELECT k AS bin, k * {SPACING} AS start FROM range(0, {HIGH // SPACING}) AS r(k))"
COUNTS = f"{EV}, {BINS}, counts AS (SELECT bin, start, count(*) AS n FROM bins JOIN ev ON minute >= start AND minute < start + {SIZE} GROUP BY bin, start)"

# sliding bins and segments


@query(f"WITH {COUNTS} SELECT bin, start, n FROM counts")
def w1_sliding_bins(spark, sf_dir):
    return intervals.bin_counts(events(spark, sf_dir), "minute", 0, HIGH, SPACING, SIZE)


@query(f"WITH {EV}, {BINS} SELECT user_id, bin, start, count(*) AS n FROM bins JOIN ev ON minute >= start AND minute < start + {SIZE} GROUP BY ALL")
def w2_bin_by_sample(spark, sf_dir):
    return intervals.bin_counts(events(spark, sf_dir), "minute", 0, HIGH, SPACING, SIZE, by=("user_id",))


@query(f"""WITH {COUNTS}, kept AS (SELECT * FROM counts WHERE 100 * n * (SELECT count(*) FROM counts) >= 125 * (SELECT sum(n) FROM counts)),
g AS (SELECT *, bin - row_number() OVER (ORDER BY bin) AS island FROM kept)
SELECT min(start) AS start, max(start) + {SPACING} AS "end", count(*) AS n, max(n) AS ratio FROM g GROUP BY island""")
def w3_segments(spark, sf_dir):
    bins = intervals.bin_counts(events(spark, sf_dir), "minute", 0, HIGH, SPACING, SIZE)
    total = bins.agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    kept = bins.join(F.broadcast(total), 100 * F.col("n") * F.col("c") >= 125 * F.col("s"))
    return intervals.segments(kept, SPACING, score="n")


@query(f"""WITH {EV}, {BINS}, u AS (SELECT DISTINCT user_id, user_id % 3 AS dosage FROM ev),
c AS (SELECT user_id, bin, count(*) AS n FROM bins JOIN ev ON minute >= start AND minute < start + {SIZE} GROUP BY ALL),
full_grid AS (SELECT b.bin, u.user_id, u.dosage::DOUBLE AS x, coalesce(n, 0)::DOUBLE AS y FROM bins b CROSS JOIN u LEFT JOIN c ON c.bin = b.bin AND c.user_id = u.user_id),
s AS (SELECT bin, count(*) AS n, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(y * y) - sum(y) * sum(y) / count(*) AS syy, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy FROM full_grid GROUP BY bin)
SELECT bin, round(CASE WHEN sxx <= 1e-12 OR syy <= 1e-12 THEN 1.0 ELSE sqrt(syy / (syy - sxy * sxy / sxx)) END, 6) AS ratio FROM s""")
def t10_association(spark, sf_dir):
    ev = events(spark, sf_dir)
    samples = ev.select(F.col("user_id").alias("sample")).distinct()
    steps = intervals.bin_steps(ev.withColumnRenamed("user_id", "sample"), "minute", 0, HIGH, SPACING, SIZE, by=("sample",))
    scored = assoc.score_steps(steps, samples.withColumn("dosage", F.col("sample") % 3), intervals.bin_grid(spark, 0, HIGH, SPACING))
    return scored.select("bin", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, min(minute) AS first_minute, max(minute) AS last_minute FROM ev WHERE minute BETWEEN 1000 AND 20000 GROUP BY event_type")
def f7_region_filter(spark, sf_dir):
    ev = events(spark, sf_dir).select(F.col("event_type").alias("chr"), F.col("minute").alias("start"), F.col("minute").alias("end"))
    region = None
    for kind in TYPES:
        part = text.in_region(kind, 1000, 20000)
        region = part if region is None else region | part
    return ev.where(region).groupBy(F.col("chr").alias("event_type")).agg(F.count("*").alias("n"), F.min("start").alias("first_minute"), F.max("start").alias("last_minute"))


# tables and expressions


@query("SELECT doc_id, 'quality' AS sample, quality AS gt FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def s8_unpivot(spark, sf_dir):
    return text.unpivot_samples(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query("SELECT n_name, n_nationkey FROM nation")
def f2_transpose_pick(spark, sf_dir):
    return expr.columns_where(table(spark, sf_dir, "nation"), "n_name", "NATION_24 > 20")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment GLOB '*H?L*' OR c_mktsegment GLOB 'AUTO*'")
def e16_like(spark, sf_dir):
    return expr.rows_where(table(spark, sf_dir, "customer"), "c_mktsegment LIKE '*H?L*' OR c_mktsegment ~= 'AUTO*'").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND p_size <= 25")
def e17_has(spark, sf_dir):
    return expr.rows_where(table(spark, sf_dir, "part"), "p_name HAS 'ring' AND p_size <= 25").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def e18_in(spark, sf_dir):
    return expr.rows_where(table(spark, sf_dir, "orders"), "o_orderpriority IN '1-URGENT|5-LOW'").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 250000")
def e13_and_or_precedence(spark, sf_dir):
    return expr.rows_where(table(spark, sf_dir, "orders"), "o_orderstatus == 'F' OR o_orderstatus == 'O' AND o_totalprice > 250000").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND NOT o_totalprice < 100000")
def e15_not(spark, sf_dir):
    return expr.rows_where(table(spark, sf_dir, "orders"), "NOT o_orderstatus == 'F' AND NOT o_totalprice < 100000").select("o_orderkey")


@query("""WITH k AS (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)
SELECT event_id, CASE WHEN try_cast(k AS DOUBLE) IS NOT NULL THEN (try_cast(k AS DOUBLE) < 9)::INT END AS low, (event_type < k)::INT AS mixed FROM k""")
def e5_dual_type(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    return ev.select("event_id", expr.expression(ev, "k < 9").cast("int").alias("low"), expr.expression(ev, "event_type < k").cast("int").alias("mixed"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity - 2 * -l_quantity AS v FROM lineitem")
def e6_arithmetic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", expr.expression(li, "l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity - 2 * -l_quantity").alias("v"))


@query("SELECT c_custkey, c_mktsegment || '-' || c_name AS label FROM customer")
def e7_concat(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", expr.expression(c, "c_mktsegment + '-' + c_name").alias("label"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2 AND n_nationkey <> 7")
def f4_names_and_positions(spark, sf_dir):
    return expr.rows_where(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "@2 >= 2 AND $n_nationkey != 7").select("n_nationkey", "n_name")


# as-of and interpolation


@query("""WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT c.event_id, c.user_id, p.ts AS ts_right, p.value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def j5_asof(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    clicks = ev.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return asof.asof(clicks, ev.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", ("value",)).select("event_id", "user_id", "ts_right", "value")


def purchases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Knots: a user's purchases by minute; queries: the user's clicks by minute."""
    ev = events(spark, sf_dir)
    knots = ev.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("grp"), F.col("minute").cast("double").alias("t")).agg(F.max("value").alias("y"))
    return knots, ev.where("event_type = 'click'").select(F.col("user_id").alias("grp"), F.col("minute").cast("double").alias("t")).distinct()


PURCHASES = f"""{EV}, k AS (SELECT user_id AS grp, minute::DOUBLE AS t, max(value) AS y, row_number() OVER (PARTITION BY user_id ORDER BY minute) AS i FROM ev WHERE event_type = 'purchase' GROUP BY user_id, minute),
q AS (SELECT DISTINCT user_id AS grp, minute::DOUBLE AS t FROM ev WHERE event_type = 'click')"""
#: Interval i of each query over knots k (grp, t, y, i) and queries q (grp, t).
BRACKET = """c AS (SELECT grp, count(*) AS n FROM k GROUP BY grp),
b AS (SELECT q.grp, q.t, greatest(1, least(any_value(c.n) - 1, count(k.t))) AS i, any_value(c.n) AS n FROM q LEFT JOIN c ON c.grp = q.grp LEFT JOIN k ON k.grp = q.grp AND k.t <= q.t GROUP BY q.grp, q.t)"""


@query(f"""WITH {PURCHASES}, f AS (SELECT q.grp, q.t, min(k.t) AS at FROM q LEFT JOIN k ON k.grp = q.grp AND k.t >= q.t GROUP BY q.grp, q.t), m AS (SELECT grp, max(t) AS last FROM k GROUP BY grp)
SELECT f.grp, f.t, k.y AS value FROM f LEFT JOIN m ON m.grp = f.grp LEFT JOIN k ON k.grp = f.grp AND k.t = coalesce(f.at, m.last)""")
def i1_step(spark, sf_dir):
    return asof.step_value(*purchases(spark, sf_dir))


@query(f"""WITH {PURCHASES}, {BRACKET}
SELECT b.grp, b.t, round(CASE WHEN n = 1 THEN k0.y ELSE k0.y + (b.t - k0.t) * (k1.y - k0.y) / (k1.t - k0.t) END, 6) AS value
FROM b LEFT JOIN k k0 ON k0.grp = b.grp AND k0.i = b.i LEFT JOIN k k1 ON k1.grp = b.grp AND k1.i = b.i + 1""")
def i2_linear(spark, sf_dir):
    return interp.linear(*purchases(spark, sf_dir), bucket=5000.0).select("grp", "t", F.round("value", 6).alias("value"))


def monthly(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Knots: a priority's order value (millions) by month; queries between and beyond the months."""
    orders = table(spark, sf_dir, "orders")
    knots = orders.groupBy(F.col("o_orderpriority").alias("grp"), month_of(F.col("o_orderdate")).cast("double").alias("t")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e8).alias("y"))
    places = knots.select("grp").distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(161)), lambda k: k / 2.0 + 0.125)))
    return knots, places


MONTHLY = f"""k AS (SELECT o_orderpriority AS grp, {MONTH}::DOUBLE AS t, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e8 AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MONTH}) AS i FROM orders GROUP BY o_orderpriority, {MONTH}),
q AS (SELECT g.grp, s.x / 2.0 + 0.125 AS t FROM (SELECT DISTINCT grp FROM k) g, range(-2, 162) AS s(x))"""


@query(f"""WITH {MONTHLY}, {BRACKET}, a AS (SELECT *, sum((t - pt) * (y + py) / 2) OVER (PARTITION BY grp ORDER BY t) AS area FROM (SELECT *, coalesce(lag(t) OVER w, t) AS pt, coalesce(lag(y) OVER w, y) AS py FROM k WINDOW w AS (PARTITION BY grp ORDER BY t))),
f AS (SELECT b.grp, b.t, a.area + (b.t - k0.t) * k0.y + (k1.y - k0.y) / (k1.t - k0.t) * (b.t - k0.t) * (b.t - k0.t) / 2 AS upto
      FROM b JOIN a ON a.grp = b.grp AND a.i = b.i JOIN k k0 ON k0.grp = b.grp AND k0.i = b.i JOIN k k1 ON k1.grp = b.grp AND k1.i = b.i + 1)
SELECT x.grp, x.t AS a, 40.125 AS b, round(z.upto - x.upto, 5) AS integral FROM f x JOIN f z ON z.grp = x.grp AND z.t = 40.125""")
def i3_integral(spark, sf_dir):
    knots, q = monthly(spark, sf_dir)
    limits = q.select("grp", F.col("t").alias("a"), F.lit(40.125).alias("b"))
    return interp.linear_integral(knots, limits).select("grp", "a", "b", F.round("integral", 5).alias("integral"))


@query(f"""WITH {MONTHLY}, {BRACKET}, z AS (SELECT b.*, CASE WHEN n % 2 = 1 THEN least(b.i - 1 + b.i % 2, n - 2) ELSE least(b.i - 1 + b.i % 2, n - 3) END AS s FROM b)
SELECT z.grp, z.t, round(k1.y + (z.t - k1.t) * ((k2.y - k1.y) / (k2.t - k1.t) + (z.t - k2.t) * ((k3.y - k1.y) / (k3.t - k1.t) - (k2.y - k1.y) / (k2.t - k1.t)) / (k3.t - k2.t)), 5) AS value
FROM z JOIN k k1 ON k1.grp = z.grp AND k1.i = z.s JOIN k k2 ON k2.grp = z.grp AND k2.i = z.s + 1 JOIN k k3 ON k3.grp = z.grp AND k3.i = z.s + 2""")
def i5_quadratic(spark, sf_dir):
    return interp.quadratic(*monthly(spark, sf_dir)).select("grp", "t", F.round("value", 5).alias("value"))


SLOPED = "k2 AS (SELECT *, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)) AS slope FROM k WINDOW w AS (PARTITION BY grp ORDER BY t))"


def _cubic_sql(value: str) -> str:
    return f"""e AS (SELECT b.grp, b.t, b.t - k0.t AS d, k1.t - k0.t AS h, k0.y AS y0, k1.y AS y1, k0.slope AS s0, k1.slope AS s1, (k1.y - k0.y) / (k1.t - k0.t) AS m
FROM b JOIN k2 k0 ON k0.grp = b.grp AND k0.i = b.i JOIN k2 k1 ON k1.grp = b.grp AND k1.i = b.i + 1)
SELECT grp, t, round(y0 + d * (s0 + d * ((m - s0) / h - (s0 + s1 - 2 * m) / h + d * (s0 + s1 - 2 * m) / (h * h))), 5) AS {value} FROM e"""


@query(f"WITH {MONTHLY}, {BRACKET}, {SLOPED}, {_cubic_sql('value')}")
def i9_hermite(spark, sf_dir):
    knots, q = monthly(spark, sf_dir)
    order = Window.partitionBy("grp").orderBy("t")
    side = lambda c, f: F.coalesce(f(c).over(order), F.col(c))
    slope = (side("y", F.lead) - side("y", F.lag)) / (side("t", F.lead) - side("t", F.lag))
    return interp.hermite(knots.withColumn("slope", slope), q).select("grp", "t", F.round("value", 5).alias("value"))


_END = lambda ha, hb, da, db: f"CASE WHEN sign(((2 * {ha} + {hb}) * {da} - {ha} * {db}) / ({ha} + {hb})) <> sign({da}) THEN 0.0 WHEN sign({da}) <> sign({db}) AND abs(((2 * {ha} + {hb}) * {da} - {ha} * {db}) / ({ha} + {hb})) > abs(3 * {da}) THEN 3 * {da} ELSE ((2 * {ha} + {hb}) * {da} - {ha} * {db}) / ({ha} + {hb}) END"


@query(f"""WITH {MONTHLY}, {BRACKET}, w4 AS (SELECT *, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS d0, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS d1,
lead(t, 2) OVER w - lead(t) OVER w AS h2, (lead(y, 2) OVER w - lead(y) OVER w) / (lead(t, 2) OVER w - lead(t) OVER w) AS d2, lag(t) OVER w - lag(t, 2) OVER w AS hm, (lag(y) OVER w - lag(y, 2) OVER w) / (lag(t) OVER w - lag(t, 2) OVER w) AS dm
FROM k WINDOW w AS (PARTITION BY grp ORDER BY t)),
k2 AS (SELECT grp, t, y, i, CASE WHEN h0 IS NULL THEN {_END('h1', 'h2', 'd1', 'd2')} WHEN h1 IS NULL THEN {_END('h0', 'hm', 'd0', 'dm')}
 WHEN d0 * d1 <= 0 THEN 0.0 ELSE sign(d0) * least(abs(d0), abs(d1)) / ((2 * h0 + h1) / (3 * (h0 + h1)) * abs(d0) / greatest(abs(d0), abs(d1)) + (h0 + 2 * h1) / (3 * (h0 + h1)) * abs(d1) / greatest(abs(d0), abs(d1))) END AS slope FROM w4),
{_cubic_sql('value')}""")
def i11_pchip(spark, sf_dir):
    return interp.pchip(*monthly(spark, sf_dir)).select("grp", "t", F.round("value", 5).alias("value"))


@query()
def i6_cubic(spark, sf_dir):
    return interp.cubic(*monthly(spark, sf_dir)).select("grp", "t", F.round("value", 5).alias("value"), F.round("slope", 5).alias("slope"), F.round("second", 5).alias("second"))


FOUR = """r AS (SELECT b.grp, b.t, (b.t - k1.t) / (k2.t - k1.t) AS u, k1.t AS t1, k2.t AS t2, k1.y AS y1, k2.y AS y2, k0.t AS t0, k3.t AS t3, coalesce(k0.y, 2 * k1.y - k2.y) AS y0, coalesce(k3.y, 2 * k2.y - k1.y) AS y3
FROM b JOIN k k1 ON k1.grp = b.grp AND k1.i = b.i JOIN k k2 ON k2.grp = b.grp AND k2.i = b.i + 1 LEFT JOIN k k0 ON k0.grp = b.grp AND k0.i = b.i - 1 LEFT JOIN k k3 ON k3.grp = b.grp AND k3.i = b.i + 2)"""


@query(f"WITH {MONTHLY}, {BRACKET}, {FOUR} SELECT grp, t, round((y0 * pow(1 - u, 3) + y1 * (3 * u * u * u - 6 * u * u + 4) + y2 * (-3 * u * u * u + 3 * u * u + 3 * u + 1) + y3 * u * u * u) / 6, 5) AS value FROM r")
def i14_b_spline(spark, sf_dir):
    return interp.b_spline(*monthly(spark, sf_dir)).select("grp", "t", F.round("value", 5).alias("value"))


@query(f"""WITH {MONTHLY}, {BRACKET}, {FOUR} SELECT grp, t, round((y0 * 16 * pow(1 - u, 3) + y1 * (16 * u * (u * u - 3 * u + 3) + 8 * (u * u * u - 3 * u * u + 2) + 4 * (u * u * u - 3 * u + 2) + 10 * (2 * u * u * u - 3 * u * u + 1))
+ y2 * (8 * u * u * (3 - u) + 4 * u * (3 - u * u) + 10 * u * u * (3 - 2 * u) + 2 * (1 - u * u * u)) + y3 * 2 * u * u * u) / 52, 5) AS value FROM r""")
def i16_beta_spline(spark, sf_dir):
    return interp.beta_spline(*monthly(spark, sf_dir), bias=2.0, tension=10.0).select("grp", "t", F.round("value", 5).alias("value"))


PARABOLA = lambda a, b, c: f"(y{a} + (t - t{a}) * ((y{b} - y{a}) / (t{b} - t{a}) + (t - t{b}) * ((y{c} - y{a}) / (t{c} - t{a}) - (y{b} - y{a}) / (t{b} - t{a})) / (t{c} - t{b})))"


@query(f"WITH {MONTHLY}, {BRACKET}, {FOUR} SELECT grp, t, round(CASE WHEN t0 IS NULL THEN {PARABOLA(1, 2, 3)} WHEN t3 IS NULL THEN {PARABOLA(0, 1, 2)} ELSE (1 - u) * {PARABOLA(0, 1, 2)} + u * {PARABOLA(1, 2, 3)} END, 5) AS value FROM r")
def i18_overhauser(spark, sf_dir):
    return interp.overhauser(*monthly(spark, sf_dir)).select("grp", "t", F.round("value", 5).alias("value"))


@query("""WITH x AS (SELECT p_partkey, (p_size::DOUBLE - 1) / 50 AS u FROM part)
SELECT p_partkey, round(pow(1 - u, 3), 8) AS b0, round(3 * u * (1 - u) * (1 - u), 8) AS b1, round(3 * u * u * (1 - u), 8) AS b2, round(u * u * u, 8) AS b3 FROM x""")
def i33_bernstein(spark, sf_dir):
    b = interp.bernstein_basis(3, F.col("p_size").cast("double"), 1.0, 51.0)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(F.get(b, F.lit(k)), 8).alias(f"b{k}") for k in range(4)))


@query(f"""WITH {MONTHLY}, {BRACKET}, s AS (SELECT grp, i, [t, lead(t) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w] AS ts, [y, lead(y) OVER w, lead(y, 2) OVER w, lead(y, 3) OVER w] AS ys FROM k WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT b.grp, b.t, round(ys[1] * (b.t - ts[2]) * (b.t - ts[3]) * (b.t - ts[4]) / ((ts[1] - ts[2]) * (ts[1] - ts[3]) * (ts[1] - ts[4])) + ys[2] * (b.t - ts[1]) * (b.t - ts[3]) * (b.t - ts[4]) / ((ts[2] - ts[1]) * (ts[2] - ts[3]) * (ts[2] - ts[4]))
 + ys[3] * (b.t - ts[1]) * (b.t - ts[2]) * (b.t - ts[4]) / ((ts[3] - ts[1]) * (ts[3] - ts[2]) * (ts[3] - ts[4])) + ys[4] * (b.t - ts[1]) * (b.t - ts[2]) * (b.t - ts[3]) / ((ts[4] - ts[1]) * (ts[4] - ts[2]) * (ts[4] - ts[3])), 4) AS value
FROM b JOIN s ON s.grp = b.grp AND s.i = greatest(1, least(b.n - 3, b.i - 1))""")
def i34_newton(spark, sf_dir):
    """The cubic through the four knots around each place, by Newton's form."""
    knots, q = monthly(spark, sf_dir)
    return interp.newton_local(knots, q, 4).select("grp", "t", F.round("value", 4).alias("value"))


@query(f"WITH {MONTHLY} SELECT q.grp, q.t, round(f.a + f.b * q.t, 5) AS value FROM q JOIN (SELECT grp, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM k GROUP BY grp) f ON f.grp = q.grp")
def i36_least_squares(spark, sf_dir):
    knots, q = monthly(spark, sf_dir)
    return interp.least_squares_value(interp.least_squares(knots, 1), q).select("grp", "t", F.round("value", 5).alias("value"))


# vectors and containers


@query(f"""WITH {EV}, d AS (SELECT user_id, minute - lag(minute) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM ev),
m AS (SELECT user_id, min(s) AS low, max(s) AS high FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN low IS NULL OR (low = 0 AND high = 0) THEN 0 WHEN low > 0 THEN 2 WHEN low = 0 THEN 1 WHEN high < 0 THEN 4 WHEN high = 0 THEN 3 ELSE -1 END AS order_type FROM m""")
def v3_order_type(spark, sf_dir):
    return vectors.order_type(events(spark, sf_dir), "user_id", "event_id", "minute")


@query("""WITH RECURSIVE r AS (SELECT n_nationkey, 1 AS k, ((n_nationkey::BIGINT + 1) * 16807) % 2147483647 AS s FROM nation UNION ALL SELECT n_nationkey, k + 1, (s * 16807) % 2147483647 FROM r WHERE k < 5)
SELECT n_nationkey, k, s::DOUBLE * 4.656612875e-10 AS u FROM (SELECT n_nationkey, k, s::BIGINT AS s FROM r)""")
def v7_lcg(spark, sf_dir):
    u = vectors.lcg_uniforms(F.col("n_nationkey") + 1, F.lit(5))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(u).alias("k", "u")).select("n_nationkey", (F.col("k") + 1).alias("k"), "u")


@query("SELECT p_partkey, round(CASE WHEN p_size = 1 THEN (p_retailprice + 2000) / 2 ELSE p_retailprice END, 6) AS first, round(CASE WHEN p_size = 1 THEN (p_retailprice + 2000) / 2 ELSE 2000.0 END, 6) AS last, p_size::INT AS n FROM part")
def v4_grid(spark, sf_dir):
    g = vectors.even_grid(F.col("p_size"), F.col("p_retailprice"), F.lit(2000.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.get(g, F.lit(0)), 6).alias("first"), F.round(F.element_at(g, -1), 6).alias("last"), F.size(g).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(sign(l_tax - 0.04) * greatest(abs(l_tax - 0.04) - 0.01, 0), 6) + 0.0 AS soft, greatest(10.0, least(l_quantity, 40.0)) AS clamped,
CASE WHEN l_discount < 0.05 THEN round((0.65 - l_discount) * 0.35 + 0.75, 6) ELSE round((0.65 - l_discount) * 0.35 + 0.75, 6) END AS beta FROM lineitem""")
def v15_shrink_and_clamp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.round(vectors.soft_threshold(F.col("l_tax") - 0.04, F.lit(0.01)), 6) + 0.0).alias("soft"),
        vectors.clamp(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("clamped"), F.round(vectors.momentum(F.col("l_discount")), 6).alias("beta"),
    )


@query("""WITH last AS (SELECT c_nationkey, c_mktsegment, arg_max(c_custkey, c_custkey) AS v FROM customer GROUP BY ALL)
SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'MACHINERY' THEN v END) AS machinery, coalesce(max(CASE WHEN c_mktsegment = 'NONE' THEN v END), -1) AS missing, count(*)::INT AS n FROM last GROUP BY c_nationkey""")
def m1_map_lookup(spark, sf_dir):
    maps = vectors.map_of(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey", "c_custkey")
    m = F.col("m")
    return maps.select("c_nationkey", vectors.lookup(m, F.lit("MACHINERY")).alias("machinery"), vectors.lookup(m, F.lit("NONE"), F.lit(-1)).cast("long").alias("missing"), F.size(m).alias("n"))


@query("""WITH h AS (SELECT n_nationkey, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * 33 + c) % 4294967296)::BIGINT AS h FROM nation)
SELECT n_nationkey, h FROM h""")
def m8_string_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", vectors.string_hash(F.col("n_name")).alias("h"))


@query("SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_orderdate, o_orderkey), 1, 3)::VARCHAR AS first_three, count(*)::INT AS n FROM orders GROUP BY o_custkey")
def o3_truncate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = vectors.first_by_group(orders, "o_custkey", ("o_orderdate", "o_orderkey"), 3)
    lists = first.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("a"))
    counts = orders.groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    shown = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["o_orderkey"].cast("string")), ", "), F.lit("]"))
    return lists.join(counts, "o_custkey").select("o_custkey", shown.alias("first_three"), "n")


@query("SELECT p_brand AS set_name, list_sort(list(DISTINCT p_partkey))::VARCHAR AS members FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def s14_sets(spark, sf_dir):
    sets = text.category_sets(table(spark, sf_dir, "part"), "p_brand", "p_partkey")
    return sets.select("set_name", F.concat(F.lit("["), F.array_join("members", ", "), F.lit("]")).alias("members"))


@query("SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def j7_repeated_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


# linear algebra


def type_counts(spark, sf_dir) -> DataFrame:
    """Cells of the matrix event type x user of counts."""
    i = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    return events(spark, sf_dir).groupBy(i.alias("i"), F.col("user_id").alias("j")).agg(F.count("*").cast("double").alias("v"))


CELLS = "a AS (SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT - 1 AS i, user_id AS j, count(*)::DOUBLE AS v FROM events GROUP BY ALL)"


@query(f"WITH {CELLS} SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY x.i, y.i")
def l8_matmul(spark, sf_dir):
    a = type_counts(spark, sf_dir)
    return linalg.matmul(a, linalg.transpose(a))


@query(f"WITH {CELLS} SELECT i, j, round((v * v - v) / v + 0.5 * v, 6) AS v FROM a")
def l4_elementwise(spark, sf_dir):
    a = type_counts(spark, sf_dir)
    square = linalg.multiply_cells(a, a)
    out = linalg.add(linalg.divide_cells(linalg.subtract(square, a), a), linalg.scale(a, 0.5))
    return out.select("i", "j", F.round("v", 6).alias("v"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT x.j::BIGINT AS i, y.j::BIGINT AS j, round(sum(x.v * y.v), 4) + 0.0 AS v FROM e x JOIN e y ON x.vec_id = y.vec_id GROUP BY x.j, y.j""")
def l13_gram(spark, sf_dir):
    return linalg.gram_of_arrays(table(spark, sf_dir, "embeddings"), "embedding").select("i", "j", (F.round("v", 4) + 0.0).alias("v"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COVARIANCES = " UNION ALL ".join(f"SELECT l_returnflag, {i}::BIGINT AS i, {j}::BIGINT AS j, covar_samp({a}, {b}) AS v FROM lineitem GROUP BY l_returnflag" for i, a in enumerate(_MEASURES) for j, b in enumerate(_MEASURES))


@query(f"SELECT l_returnflag, i, j, round(v, 3) + 0.0 AS v FROM ({_COVARIANCES})")
def a7_covariance(spark, sf_dir):
    cells = linalg.covariance(table(spark, sf_dir, "lineitem"), _MEASURES, ("l_returnflag",))
    return cells.select("l_returnflag", "i", "j", (F.round("v", 3) + 0.0).alias("v"))


@query(f"WITH {CELLS} SELECT sum(v * v) AS trace, sum(abs(v)) AS norm FROM a")
def a8_trace_and_norm(spark, sf_dir):
    a = type_counts(spark, sf_dir)
    both = linalg.frobenius(a, a).select(F.col("v").alias("trace"), F.lit(1).alias("k"))
    return both.join(linalg.norm_one(a).select(F.col("v").alias("norm"), F.lit(1).alias("k")), "k").select("trace", "norm")


@query()
def g1_glasso(spark, sf_dir):
    """Precision of each label's embedding covariance (all dimensions) at two levels."""
    cells = linalg.covariance_of_arrays(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "m"), "embedding", "m")
    return glasso.graphical_lasso(cells, [0.001, 0.004]).select("m", "level", "i", "j", F.round("v", 3).alias("v"), (F.col("gap") < 1e-6).alias("solved"))


@query()
def l16_logdet(spark, sf_dir):
    cells = linalg.covariance(table(spark, sf_dir, "lineitem"), _MEASURES, ("l_returnflag",)).withColumnRenamed("l_returnflag", "m")
    return linalg.log_determinant(linalg.cholesky(cells)).select("m", F.round("logdet", 6).alias("logdet"))


# permutation and false discovery


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, (1 + l_partkey % 997) / 998.0::DOUBLE AS p FROM lineitem),
r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p)
SELECT l_orderkey, l_linenumber, round(p, 8) AS p, round(least(1.0, min(m * p / k) OVER (ORDER BY p DESC)), 8) AS q FROM r""")
def a16_bh_fdr(spark, sf_dir):
    tests = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((1 + F.col("l_partkey") % 997) / F.lit(998.0)).alias("p"))
    return assoc.benjamini_hochberg(tests).select("l_orderkey", "l_linenumber", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query("""WITH s AS (SELECT DISTINCT user_id AS sample, user_id % 3 AS dosage FROM events), e AS (SELECT s.*, r.rep FROM s, range(1, 21) AS r(rep)),
k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY sample) AS k, row_number() OVER (PARTITION BY rep ORDER BY md5(sample::VARCHAR || ':' || rep::VARCHAR || ':1'), sample) AS h FROM e)
SELECT a.rep::INT AS rep, a.sample, b.dosage FROM k a JOIN k b ON a.rep = b.rep AND a.k = b.h""")
def a17_permute(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), (F.col("user_id") % 3).alias("dosage")).distinct()
    return assoc.permuted(samples, 20)


@query("SELECT (EXTRACT(EPOCH FROM time_bucket(INTERVAL 10 MINUTE, ts)) / 60 - 10 * g)::BIGINT AS start_minute, count(*) AS n FROM events, range(0, 15) AS r(g) GROUP BY 1")
def stream_sliding_counts(spark, sf_dir):
    """The events as a stream through sliding windows, run to the end of the input."""
    from marlstone.plans.folders import shared_folder
    from marlstone.streaming import bins

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = bins.run_to_files(bins.sliding_counts(stream), shared_folder(spark))
    zone = F.current_timezone()
    utc = F.to_utc_timestamp("start", zone)
    return counts.select((minute_of(utc) + F.date_diff(F.lit("2024-01-01").cast("date"), F.lit("1970-01-01").cast("date")) * 1440).cast("long").alias("start_minute"), "n")
