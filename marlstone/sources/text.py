"""Text sources and sinks: delimited lines, genotype tables, cut sites, gene sets, segments.

Files are read by Spark's readers, so directories, globs and remote stores
work and large files are split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_fields(line: Column, sep: str = "\t", second: str | None = None, multi: bool = False, limit: int = -1) -> Column:
    """Fields of a line, each stripped of leading and trailing spaces.

    One or two separator characters; with ``multi`` a run of separators counts
    once and leading ones make no field. With ``limit`` further separators stay
    inside the last field.
    """
    either = "[" + re.escape(sep + (second or sep)) + "]"
    if multi:
        line = F.regexp_replace(line, f"^{either}+", "")
        fields = F.split(line, f"{either}+", limit)
        fields = F.filter(fields, lambda x: x != "") if limit < 0 else fields
    else:
        fields = F.split(line, either, limit)
    return F.transform(fields, lambda x: F.trim(x))  # spaces only


def scan_lines(spark: SparkSession, path: str, sep: str = "\t", second: str | None = None, multi: bool = False, limit: int = -1) -> DataFrame:
    """``(fields)`` of every non-empty line; CR, LF and CRLF end lines, and a last line without an end is kept."""
    raw = spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("value")).where("value != ''")
    return raw.select(split_fields(F.col("value"), sep, second, multi, limit).alias("fields"))


def cell(fields: Column, k: int) -> Column:
    """Field k (0 up); a missing one reads as the empty string."""
    return F.coalesce(F.get(fields, F.lit(k)), F.lit(""))


def scan_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header line in every file; all columns are strings without outer spaces, and missing cells are empty strings."""
    read = spark.read.csv(path, sep=sep, header=True, quote="", escape="")
    return read.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip(" ")) for c in read.columns))


def unpivot_samples(table: DataFrame, ids: list[str], name: str = "sample", value: str = "gt") -> DataFrame:
    """Wide to long: one row for each id and sample column."""
    samples = [c for c in table.columns if c not in ids]
    return table.unpivot(ids, samples, name, value)


def genotypes(spark: SparkSession, path: str) -> DataFrame:
    """``(rsid, a1, a2, sample, gt, dosage)``; ``NA`` is null, dosage counts letters that are A2."""
    long = unpivot_samples(scan_table(spark, path), ["RSID", "A1", "A2"])
    gt = F.nullif("gt", F.lit("NA"))
    return long.select(F.col("RSID").alias("rsid"), F.col("A1").alias("a1"), F.col("A2").alias("a2"), "sample", gt.alias("gt"), dosage(gt, F.col("a2")).alias("dosage"))


def dosage(gt: Column, a2: Column) -> Column:
    """Letters of the call that are A2; null where the call is."""
    return F.when(gt.isNotNull(), F.size(F.filter(F.split(gt, ""), lambda x: x == a2)))


def cut_sites(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, chr, start, end)`` of every ``<sample>_*`` file below ``path``.

    The sample comes from the files' metadata, so a filter on it is applied to
    the list of files and files of other samples are not opened.
    """
    sample = F.regexp_extract("_metadata.file_name", r"^([^_]+)_", 1)
    read = spark.read.csv(path, sep="\t", header=True, schema="chr string, start int, end int")
    return read.select(sample.alias("sample"), "chr", "start", "end")


def in_region(chrom: str, low: int, high: int) -> Column:
    """Intervals (chr, start, end) that touch [low, high]."""
    return (F.col("chr") == chrom) & (F.col("start") <= high) & (F.col("end") >= low)


def scan_gene_sets(spark: SparkSession, path: str, mapping: DataFrame | None = None) -> DataFrame:
    """``(set_name, member)`` of a gene-set file (name, description, members); ``mapping`` (key, id) translates members."""
    lines = scan_lines(spark, path)
    members = F.filter(F.slice("fields", 3, F.greatest(F.size("fields") - 2, F.lit(0))), lambda x: x != "")
    out = lines.select(cell(F.col("fields"), 0).alias("set_name"), F.explode(members).alias("member"))
    if mapping is None:
        return out
    return out.join(mapping.select(F.col("key").alias("member"), "id"), "member").select("set_name", F.col("id").alias("member"))


def check_identifiers(sets: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``(member, n_keys)`` of set members whose key is absent (0) or repeated (2 or more)."""
    counted = keys.groupBy(F.col(key).alias("member")).agg(F.count("*").alias("n_keys"))
    found = sets.select("member").distinct().join(counted, "member", "left")
    return found.select("member", F.coalesce("n_keys", F.lit(0)).alias("n_keys")).where("n_keys != 1")


def category_sets(table: DataFrame, category: str, key: str) -> DataFrame:
    """``(set_name, members)``: the sorted distinct keys of each category."""
    return table.where(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("set_name")).agg(F.sort_array(F.collect_set(key)).alias("members"))


def save_gene_sets(sets: DataFrame, path: str) -> None:
    """Write ``(set_name, members)`` one line a set: name, description (the name), members."""
    members = F.transform("members", lambda x: x.cast("string"))
    sets.select(F.concat_ws("\t", "set_name", "set_name", members)).write.mode("overwrite").text(path)


def number_text(x: Column) -> Column:
    """A double with at most 6 significant digits (halves away from zero), without closing zeros."""
    shown = F.format_string("%.6g", x)
    plain = F.regexp_replace(shown, r"(\.[0-9]*?)0+(?=e|$)", "$1")
    return F.regexp_replace(plain, r"\.(?=e|$)", "")


SEGMENT_COLUMNS = ["ID", "chrom", "loc.start", "loc.end", "num.mark", "L2norm_ratio", "Lambda2_threshold", "seg.mean"]


def _segment_columns(segments: DataFrame, tool: str) -> list[Column]:
    optional = lambda c: number_text(F.col(c).cast("double")) if c in segments.columns else F.lit("NA")
    values = [F.lit(tool), F.col("chrom"), F.col("start"), F.col("end"), F.col("n"), number_text(F.col("ratio").cast("double")), optional("threshold"), optional("mean")]
    return [v.cast("string").alias(c) for v, c in zip(values, SEGMENT_COLUMNS, strict=True)]


def save_segment_file(segments: DataFrame, prefix: str, tool: str = "marlstone") -> None:
    """Write segments (chrom, start, end, n, ratio[, threshold, mean]) as the one file ``<prefix>.seg``, largest ratio first.

    Tasks sort and write ranges of the ratio; only the commit joins their files.
    """
    from marlstone.sources.single_file import save_lines

    lines = segments.orderBy(F.desc("ratio"), "chrom", "start").select(F.concat_ws("\t", *_segment_columns(segments, tool)).alias("line"))
    save_lines(lines, f"{prefix}.seg", "\t".join(SEGMENT_COLUMNS))


def save_segments(segments: DataFrame, path: str, tool: str = "marlstone") -> None:
    """Write segments as :func:`save_segment_file` does, in a folder of one part file by Spark's own writer."""
    named = _segment_columns(segments, tool)
    segments.orderBy(F.desc("ratio")).select(*named).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def matrix_text(cells: DataFrame) -> DataFrame:
    """``(i, line)``: the rows of a COO matrix (i, j, v) as text, six decimals, tab-separated."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: F.format_string("%f", s["v"]))
    return cells.groupBy("i").agg(F.concat_ws("\t", row).alias("line"))
