"""The segment scan on a small fixture with a planted region, and the stream against the table."""

import math

import pytest

from marlstone.plans import segment_scan
from marlstone.sources import text


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    home = tmp_path_factory.mktemp("study")
    names = [f"s{k}" for k in range(9)]
    calls = ["GG", "GA", "AA"] * 3
    (home / "g.txt").write_text("\t".join(["RSID", "A1", "A2", *names, "s9"]) + "\r\n" + "\t".join(["rs1", "G", "A", *calls, "NA"]) + "\r\n")
    (home / "cuts").mkdir()
    for k, name in enumerate([*names, "other"]):
        planted = [(5000 + 40 * j, 5020 + 40 * j) for j in range(3 * (k % 3))]
        rest = [(1000 + 97 * j + k, 1050 + 97 * j) for j in range(5)]
        lines = ["CHR\tStart\tEnd"] + [f"7\t{a}\t{b}" for a, b in planted + rest] + ["8\t5000\t5100"]
        (home / "cuts" / f"{name}_x.txt").write_text("\n".join(lines) + "\n")
    return home


def test_segments(spark, study, tmp_path):
    positional, o = segment_scan.parse(["g", "c", "o", "-rsid:rs1", "-chr:7", "-minbp:900", "-maxbp:6000", "-l1:1.5,3", "-l2:0.2", "-p:30", "-fdr:0.5"])
    assert positional == ["g", "c", "o"] and o.l1 == [1.5, 3.0] and o.maxbp == 6000
    genotypes, cuts = text.genotypes(spark, str(study / "g.txt")), text.cut_sites(spark, str(study / "cuts"))
    table = segment_scan.bin_table(genotypes, cuts, o)
    assert table.select("sample").distinct().count() == 9 and table.count() == 9 * 510
    found = segment_scan.find_segments(genotypes, cuts, o).collect()
    assert found and all((r["end"] - r["start"]) == 10 * r["n"] and (r["start"] - 900) % 10 == 0 for r in found)
    assert all(4800 <= r["start"] and r["end"] <= 5400 and r["ratio"] >= r["l1"] and r["q"] <= 0.5 for r in found)
    assert {r["l1"] for r in found} == {1.5, 3.0} and math.isinf(max(r["ratio"] for r in found))
    text.save_segments(segment_scan.find_segments(genotypes, cuts, segment_scan.parse(["-rsid:rs1", "-chr:7", "-minbp:900", "-maxbp:6000", "-l1:1.5"])[1]), str(tmp_path / "o.seg"))
    assert text.scan_lines(spark, str(tmp_path / "o.seg")).first()["fields"] == text.SEGMENT_COLUMNS
    for wrong in ("-nosuch:1", "-p"):
        with pytest.raises(ValueError):
            segment_scan.parse([wrong])
    line = "g c o -rsid:rs1 -chr:7 -minbp:1 -maxbp:9 -binspacing:10 -binsize:150 -l1:1.00,1.025 -l2:0.0316,0.01 -p:200 -seg -fdr"
    assert segment_scan.parse(line.split())[1].fdr == 0.05 and segment_scan.parse(line.split())[1].seg
    assert segment_scan.find_segments(genotypes, cuts.where("sample = 'other'"), o).count() == 0


@pytest.mark.parametrize("offset", [0, 7])
def test_segments_over_borders_of_stretches(spark, monkeypatch, offset):
    from marlstone.operators import intervals

    monkeypatch.setattr(intervals, "STRETCH", 4)
    kept = [0, 1, 2, 3, 4, 5, 8, 11, 12, 15, 16, 17, 18, 19, 20, 23]
    bins = spark.createDataFrame([(g, offset + 10 * k, float(k), 1.0) for g in ("a", "b") for k in kept if g == "a" or k != 17], "g string, start long, score double, w double")
    got = {(r["g"], r["start"], r["end"], r["n"], r["ratio"], r["w"]) for r in intervals.segments(bins, 10, by=("g",), score="score", keep={"w": "sum"}).collect()}
    runs = lambda ks: [[k for k in ks if a <= k <= b] for a, b in zip([k for k in ks if k - 1 not in ks], [k for k in ks if k + 1 not in ks], strict=True)]
    want = {(g, offset + 10 * r[0], offset + 10 * r[-1] + 10, len(r), float(r[-1]), float(len(r))) for g, ks in (("a", kept), ("b", [k for k in kept if k != 17])) for r in runs(ks)}
    assert got == want


def test_identifiers(spark):
    sets = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z")], "set_name string, member string")
    keys = spark.createDataFrame([("x",), ("y",), ("y",)], "key string")
    assert {tuple(r) for r in text.check_identifiers(sets, keys).collect()} == {("y", 2), ("z", 0)}


def test_stream_equals_table(spark, tmp_path):
    from marlstone.streaming import bins

    events = spark.range(400).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((id * 37) % 900 as int)) as ts", "id % 3 as kind")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = bins.sliding_counts(bins.event_stream(spark, str(tmp_path / "in"), events.schema), by=("kind",))
    kept = bins.run_to_files(stream, str(tmp_path / "kept"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, bins.sliding_counts(events, by=("kind",)).collect()))
    stream = bins.sliding_counts(bins.event_stream(spark, str(tmp_path / "in"), events.schema), by=("kind",))
    bins.run_to_table(stream, "slid", str(tmp_path / "state"))
    assert sorted(map(tuple, spark.table("slid").collect())) == sorted(map(tuple, bins.sliding_counts(events, by=("kind",)).collect()))
