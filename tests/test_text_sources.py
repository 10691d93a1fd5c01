"""Text dialect, genotype tables, gene sets and sinks."""

import pytest
from pyspark.sql import functions as F

from marlstone.sources import text


@pytest.fixture
def put(tmp_path):
    def write(name, raw):
        (tmp_path / name).write_bytes(raw)
        return str(tmp_path / name)

    return write


def fields(df):
    return [r["fields"] for r in df.collect()]


def test_lines(spark, put):
    path = put("a.txt", b"a\tb \t c\r\n\n\rx\t\ty\textra\nlast\tline")
    assert fields(text.scan_lines(spark, path)) == [["a", "b", "c"], ["x", "", "y", "extra"], ["last", "line"]]
    assert fields(text.scan_lines(spark, path, limit=3))[1] == ["x", "", "y\textra"]
    multi = put("b.txt", b"  a, b ,,c\n")
    assert fields(text.scan_lines(spark, multi, ",", " ", multi=True)) == [["a", "b", "c"]]


def test_tables_of_several_files_and_rows_like_the_header(spark, put, tmp_path):
    (tmp_path / "t").mkdir()
    put("t/a.txt", b"k\tv\r\nk\tv\r\n1\t\"x\r\n")
    put("t/b.txt", b"k\tv\n2\n\n3\t y \tz")
    got = {tuple(r) for r in text.scan_table(spark, str(tmp_path / "t")).collect()}
    assert got == {("k", "v"), ("1", '"x'), ("2", ""), ("3", "y")}


def test_genotypes_and_sites(spark, put, tmp_path):
    g = text.genotypes(spark, put("g.txt", b"RSID\tA1\tA2\ts1\ts2\ts3\r\nrs1\tG\tA\tGA\tNA\tAA\r\nrs2\tC\tT\tCC\r\n"))
    got = {(r["rsid"], r["sample"]): r["dosage"] for r in g.collect()}
    assert got == {("rs1", "s1"): 1, ("rs1", "s2"): None, ("rs1", "s3"): 2, ("rs2", "s1"): 0, ("rs2", "s2"): 0, ("rs2", "s3"): 0}
    (tmp_path / "cuts").mkdir()
    put("cuts/M1_sites.txt", b"CHR\tStart\tEnd\n7\t10\t20\n5\t1\t2\n")
    put("cuts/M2_sites.txt", b"CHR\tStart\tEnd\n7\t30\t40\n")
    sites = text.cut_sites(spark, str(tmp_path / "cuts"))
    assert {tuple(r) for r in sites.where(text.in_region("7", 15, 30)).collect()} == {("M1", "7", 10, 20), ("M2", "7", 30, 40)}
    assert sites.join(g, "sample").count() == 0


def test_gene_sets(spark, put, tmp_path):
    sets = text.scan_gene_sets(spark, put("s.gmt", b"A\tdesc\tx\ty\t\nB\t\tz\nC\tonly\n"))
    assert {tuple(r) for r in sets.collect()} == {("A", "x"), ("A", "y"), ("B", "z")}
    mapped = text.scan_gene_sets(spark, put("s.gmt", b"A\tdesc\tx\ty\n"), spark.createDataFrame([("x", 7)], "key string, id int"))
    assert [tuple(r) for r in mapped.collect()] == [("A", 7)]
    cats = text.category_sets(spark.createDataFrame([("u", 2), ("u", 1), ("u", 1), (None, 3)], "c string, k int"), "c", "k")
    text.save_gene_sets(cats, str(tmp_path / "out"))
    back = text.scan_gene_sets(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == {("u", "1"), ("u", "2")}


def test_numbers_and_segments(spark, tmp_path):
    shown = spark.createDataFrame([(1.18309,), (49.6473,), (10.0,), (0.0581607,), (1e-7,), (123456789.0,)], "v double").select(text.number_text(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["1.18309", "49.6473", "10", "0.0581607", "1e-07", "1.23457e+08"]
    text.save_segments(spark.createDataFrame([("7", 100, 300, 20, 1.25)], "chrom string, start int, end int, n int, ratio double"), str(tmp_path / "seg"))
    lines = [r["fields"] for r in text.scan_lines(spark, str(tmp_path / "seg")).collect()]
    assert lines == [text.SEGMENT_COLUMNS, ["marlstone", "7", "100", "300", "20", "1.25", "NA", "NA"]]
    matrix = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.5)], "i int, j int, v double")
    assert text.matrix_text(matrix).first()["line"] == "1.000000\t2.500000"
