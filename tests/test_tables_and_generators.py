"""Annotated tables, the single-file sink, file pruning, column masks, jump-ahead generator and keyed permutations."""

import os
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import expr, vectors
from marlstone.operators import assoc
from marlstone.sources import annotated, single_file, text


def test_annotated_tables_of_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"id\tgene\ts1\ts2\r\n#\t\tred\tblue\r\nr1\tB\t1\t 2.5 \r\n\r\nr2\tA\tx\r\nr3\tC\t-3\t4\t5")
    (tmp_path / "b.txt").write_bytes(b"gene\tid\ts9\n#\t#\tgreen\nZ\tq1\t7\nB\tq2\n")
    t = annotated.read_annotated(spark, str(tmp_path), rows=2, cols=2)
    short = lambda rows: sorted((os.path.basename(r[0]), *r[1:]) for r in rows)
    assert short(t.keys("gene").collect()) == [("a.txt", 0, "B"), ("a.txt", 1, "A"), ("a.txt", 2, "C"), ("b.txt", 0, "Z"), ("b.txt", 1, "B")]
    assert short(t.keys(0).collect()) == [("a.txt", 0, "r1"), ("a.txt", 1, "r2"), ("a.txt", 2, "r3"), ("b.txt", 0, "Z"), ("b.txt", 1, "B")]
    assert short(t.index("gene").collect()) == [("a.txt", 0, "A", 1), ("a.txt", 1, "B", 0), ("a.txt", 2, "C", 2), ("b.txt", 0, "B", 1), ("b.txt", 1, "Z", 0)]
    assert short(t.index("s1", numeric=True).collect()) == [("a.txt", 0, "-3", 2), ("a.txt", 1, "1", 0), ("a.txt", 2, "x", 1)]
    assert short(t.scores().collect()) == [("a.txt", 0, 0, 1.0), ("a.txt", 0, 1, 2.5), ("a.txt", 2, 0, -3.0), ("a.txt", 2, 1, 4.0), ("a.txt", 2, 2, 5.0), ("b.txt", 0, 0, 7.0)]
    assert short(t.column_annotations().collect()) == [("a.txt", 1, 2, "red"), ("a.txt", 1, 3, "blue"), ("b.txt", 1, 2, "green")]
    assert ("a.txt", 1, 1, "A") in short(t.row_annotations().collect()) and t.row_annotations().count() == 10
    assert t.keys("absent").count() == 0


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"{k}\t{'x' * (k % 50)}" for k in range(4000)]
    (tmp_path / "long.txt").write_text("\n\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = annotated.numbered_lines(spark, str(tmp_path))
        assert all(str(r["line"]) == r["fields"][0] for r in read.collect()) and read.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_in_order_and_clean_abort(spark, tmp_path):
    path = str(tmp_path / "deep" / "out.txt")
    rows = spark.range(0, 1000, 1, 7).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("line"))
    single_file.save_lines(rows, path, "head")
    assert open(path).read().split("\n") == ["head", *map(str, range(999, -1, -1)), ""]
    failing = rows.select(F.when(F.col("line") == "500", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("line")).alias("line"))
    with pytest.raises(Exception, match="stop"):
        single_file.save_lines(failing, path)
    assert open(path).readline() == "head\n" and os.listdir(tmp_path / "deep") == ["out.txt"]
    single_file.save_lines(rows.limit(0), path)
    assert open(path).read() == ""


def test_segment_file(spark, tmp_path):
    found = spark.createDataFrame([("7", 100, 300, 20, 1.25), ("7", 500, 600, 10, 3.0)], "chrom string, start int, end int, n int, ratio double")
    text.save_segment_file(found, str(tmp_path / "x"))
    assert open(tmp_path / "x.seg").read() == "\t".join(text.SEGMENT_COLUMNS) + "\nmarlstone\t7\t500\t600\t10\t3\tNA\tNA\nmarlstone\t7\t100\t300\t20\t1.25\tNA\tNA\n"


def test_cut_sites_of_other_samples_are_not_opened(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"M{k}_Tn5_cut_sites.txt").write_text(f"CHR\tStart\tEnd\n7\t{k}\t9\n")
    one = text.cut_sites(spark, str(tmp_path)).where("sample = 'M3'")
    assert [tuple(r) for r in one.collect()] == [("M3", "7", 3, 9)]
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.queryExecution().toRdd().count()
    scans = [n for n in [plan] if n.nodeName().startswith("Scan")] or [plan.collectLeaves().apply(0)]
    assert scans[0].metrics().apply("numFiles").value() == 1


def test_column_masks(spark):
    wide = spark.createDataFrame([("r1", 1, 5, 7), ("r2", 9, 2, None), ("r 3", 4, 4, 4)], "k string, x int, y int, `z.z` int")
    for source, want in (("r1 > 2", ["y", "z.z"]), ("r1 > 2 AND r2 < 3", ["y"]), ("$r2 == 9", ["x"]), ('"r 3" == 4', ["x", "y", "z.z"]), ("TRUE", ["x", "y", "z.z"])):
        assert expr.columns_where(wide, "k", source).columns == ["k", *want], source
    with pytest.raises(expr.ExpressionError):
        expr.columns_where(wide, "k", "r9 > 2")


def test_jump_ahead(spark):
    s, states = 12345, []
    for _ in range(300):
        s = s * 16807 % 2147483647
        states.append(s)
    got = vectors.lcg_sequence(spark, 12345, 300, parts=7).orderBy("k").collect()
    assert [r["u"] for r in got] == [x * vectors.LCG_SCALE for x in states]
    far = spark.createDataFrame([(10**11,), (0,), (2147483646,)], "k long").select(vectors.lcg_state(F.lit(7), F.col("k")).alias("s")).collect()
    assert [r["s"] for r in far] == [7 * pow(16807, 10**11, 2147483647) % 2147483647, 7, 7]
    low = [r["u"] for r in vectors.lcg_sequence(spark, 3, 50, 2.0, 4.0).collect()]
    assert all(2 < u < 4 for u in low)


def test_keyed_permutations(spark):
    for n in (1, 2, 3, 10, 97, 256):
        rows = spark.range(n).select("id", *(assoc.keyed_permutation(F.col("id"), F.lit(n), F.lit(key)).alias(f"p{key}") for key in (1, 2, 99))).collect()
        for key in (1, 2, 99):
            assert sorted(r[f"p{key}"] for r in rows) == list(range(n))
    samples = spark.createDataFrame([(f"s{k}", k, random.Random(k).randrange(3)) for k in range(60)], "sample string, number long, dosage int")
    dealt = assoc.permuted_by_key(samples, 200)
    by: dict[int, list] = {}
    first = []
    for r in dealt.collect():
        by.setdefault(r["rep"], []).append((r["sample"], r["dosage"]))
        if r["sample"] == "s0":
            first.append(r["dosage"])
    plain = sorted(r["dosage"] for r in samples.collect())
    assert len(by) == 200 and all(sorted(d for _, d in v) == plain for v in by.values())
    assert len({tuple(sorted(v)) for v in by.values()}) > 190
    share = plain.count(0) / 60
    assert abs(first.count(0) / 200 - share) < 0.15


def test_keyed_permutations_in_batches_and_tasks(spark, monkeypatch):
    def plain(x, n, key):
        mixed = lambda x, key: ((((x * 16807 + key) % 2147483647) * 48271 + key) % 2147483647) * 69621 % 2147483647
        for r in range(48):
            partner = (mixed(key + r * 7919, r + 1) % n - x + n) % n
            x = partner if mixed(max(x, partner), key + r * 104729) >> 11 & 1 else x
        return x

    asked = [(x, n, key) for n in (1, 5, 2147483646) for key in (0, 77, 2147483646) for x in (0, n // 2, n - 1)]
    table = spark.createDataFrame([*asked, (None, 5, 1)], "x long, n long, key long").coalesce(1)
    found = table.select("*", assoc.keyed_permutation(F.col("x"), F.col("n"), F.col("key")).alias("to"))
    assert [tuple(r) for r in found.collect()] == [*((*a, plain(*a)) for a in asked), (None, 5, 1, None)]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # rounds row by row
    monkeypatch.setattr(assoc, "PERMUTED_ROWS", 10, raising=False)
    samples = spark.range(50).coalesce(1).select(F.col("id").alias("sample"), F.col("id").alias("number"), (F.col("id") * 3).alias("dosage"))
    dealt = assoc.permuted_by_key(samples, 4, seed=2)
    assert "Repartition 20" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["rep"], r["sample"]): r["dosage"] for r in dealt.collect()} == {(rep, x): 3 * plain(x, 50, rep + 2 * 1_000_003) for rep in range(1, 5) for x in range(50)}
