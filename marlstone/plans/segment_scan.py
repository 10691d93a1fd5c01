"""Segments of a genomic window whose cut-site counts follow a variant's dosage.

    python -m marlstone.plans.segment_scan genotypes.txt cuts/ out -rsid:rs1 -chr:7 -minbp:1 -maxbp:9000
        -binspacing:10 -binsize:150 -l1:1.075 -l2:0.03162 -p:100

Statistics are this engine's own definitions (see ``operators.assoc``): a bin
is kept when its ratio is at least l1 and its effect (change of the count for
each allele) at least l2; adjacent kept bins make a segment. With ``-p`` each
kept bin gets a permutation p-value and its Benjamini-Hochberg q-value, and
``-fdr:x`` keeps bins with q <= x; ``-fdr`` alone takes 0.05. ``-seg`` writes the
segments, which is also what happens without it.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import assoc, intervals
from marlstone.sources import text


@dataclass
class Options:
    rsid: str = ""
    chr: str = ""
    minbp: int = 0
    maxbp: int = 0
    binspacing: int = 10
    binsize: int = 150
    l1: list[float] = field(default_factory=lambda: [1.0])
    l2: list[float] = field(default_factory=lambda: [0.0])
    p: int = 0
    fdr: float = 1.0
    seg: bool = True


#: What options mean that stand without a value.
BARE = {"fdr": 0.05, "seg": True}


def parse(arguments: list[str]) -> tuple[list[str], Options]:
    """Positional arguments and ``-name:value`` options; l1 and l2 take comma-separated lists."""
    options, positional = Options(), []
    for a in arguments:
        if not a.startswith("-"):
            positional.append(a)
            continue
        name, _, value = a[1:].partition(":")
        if not hasattr(options, name):
            raise ValueError(f"unknown option -{name}")
        old = getattr(options, name)
        if not value:
            if name not in BARE:
                raise ValueError(f"-{name} needs a value")
            setattr(options, name, BARE[name])
            continue
        setattr(options, name, [float(x) for x in value.split(",")] if isinstance(old, list) else type(old)(value))
    return positional, options


def _called_ends(genotypes: DataFrame, cuts: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ends, calls, grid)``: both interval ends of the samples with a call and a file, these samples, all bins."""
    calls = genotypes.where((F.col("rsid") == o.rsid) & F.col("dosage").isNotNull()).select("sample", "dosage")
    calls = calls.join(cuts.select("sample").distinct(), "sample", "left_semi")
    ends = intervals.interval_ends(cuts.where(text.in_region(o.chr, o.minbp, o.maxbp)).select("sample", "start", "end"))
    return ends.join(calls.select("sample"), "sample", "left_semi"), calls, intervals.bin_grid(genotypes.sparkSession, o.minbp, o.maxbp, o.binspacing)


def bin_counts(genotypes: DataFrame, cuts: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(counts, calls, grid)``: counts of both interval ends by bin and sample, the samples with a call and a file, all bins."""
    ends, calls, grid = _called_ends(genotypes, cuts, o)
    return intervals.bin_counts(ends, "position", o.minbp, o.maxbp, o.binspacing, o.binsize, by=("sample",)), calls, grid


def bin_table(genotypes: DataFrame, cuts: DataFrame, o: Options) -> DataFrame:
    """``(bin, sample, dosage, n)``: the counts of every bin for every sample, with zeros."""
    counts, calls, grid = bin_counts(genotypes, cuts, o)
    return assoc.complete(counts, calls, grid).join(calls, "sample")


def find_segments(genotypes: DataFrame, cuts: DataFrame, o: Options) -> DataFrame:
    """``(l1, l2, chrom, start, end, n, ratio, threshold, mean[, p, q])`` for every pair of floors."""
    ends, calls, grid = _called_ends(genotypes, cuts, o)
    steps = intervals.bin_steps(ends, "position", o.minbp, o.maxbp, o.binspacing, o.binsize, by=("sample",))
    bins = assoc.score_steps(steps, calls.distinct(), grid).where((F.col("ratio") >= min(o.l1)) & (F.col("effect") >= min(o.l2)))
    extra = []
    if o.p:
        drawn = assoc.score_steps(steps, assoc.permuted(calls.distinct(), o.p), bins, by=("rep",)).select("bin", "ratio")
        tested = assoc.benjamini_hochberg(assoc.permutation_p(bins.select("bin", "ratio"), drawn).select("bin", "p"))
        bins = bins.join(tested, "bin").where(F.col("q") <= o.fdr)
        extra = ["p", "q"]
    floors = F.array(*(F.struct(F.lit(a).alias("l1"), F.lit(b).alias("l2")) for a in o.l1 for b in o.l2))
    bins = bins.withColumn("start", o.minbp + F.col("bin") * o.binspacing).withColumn("floor", F.explode(floors)).select("*", "floor.*").where("ratio >= l1 and effect >= l2")
    kept = bins.select("l1", "l2", "start", "ratio", F.col("effect").alias("threshold"), "mean", *extra)
    out = intervals.segments(kept, o.binspacing, by=("l1", "l2"), keep={"ratio": "max", "threshold": "max", "mean": "sum", **dict.fromkeys(extra, "min")})
    out = out.withColumn("mean", F.col("mean") / F.col("n")).withColumn("chrom", F.lit(o.chr))
    return out.select("l1", "l2", "chrom", "start", "end", "n", "ratio", "threshold", "mean", *extra)


def main(arguments: list[str]) -> None:
    if "-?" in arguments or len(arguments) < 3:
        print(__doc__)
        return
    (genotype_file, cut_folder, prefix), o = parse(arguments)
    spark = SparkSession.builder.getOrCreate()
    found = find_segments(text.genotypes(spark, genotype_file), text.cut_sites(spark, cut_folder), o)
    text.save_segment_file(found, prefix)


if __name__ == "__main__":
    main(sys.argv[1:])
