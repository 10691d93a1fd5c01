"""Ragged text tables with annotation rows and columns.

A file's first lines are annotation rows, the very first its header; the first
fields of every line are annotation columns. Lines keep their file and number,
names are resolved file by file, and the rest of the table is a matrix of
numbers as cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import numeric_text
from marlstone.operators.ranges import stored
from marlstone.sources.text import cell, split_fields


def numbered_lines(spark: SparkSession, path: str, sep: str = "\t", multi: bool = False) -> DataFrame:
    """``(file, line, fields)`` of every non-empty line, numbered from 0 in each file.

    A split of a file numbers its own lines; how many lie before it comes from
    the splits' counts. No task sees more than a split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    lines = raw.select("file", "split", "at", F.posexplode(F.split("value", "\r")).alias("part", "value")).where("value != ''")
    lines = stored(lines.select("file", "split", "at", "part", split_fields(F.col("value"), sep, multi=multi).alias("fields")))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "split").orderBy("at", "part"))
    return lines.join(counts, ["file", "split"]).select("file", (F.col("before") + own - 1).alias("line"), "fields")


@dataclass(frozen=True)
class AnnotatedTable:
    """Numbered lines, of which the first ``rows`` annotate columns and the first ``cols`` fields annotate rows."""

    lines: DataFrame
    rows: int = 1
    cols: int = 1

    def header(self) -> DataFrame:
        """``(file, column, name)`` of each file's first line."""
        return self.lines.where("line = 0").select("file", F.posexplode("fields").alias("column", "name"))

    def column_annotations(self) -> DataFrame:
        """``(file, line, column, text)`` of the annotation rows after the header, beside the annotation columns."""
        some = self.lines.where(F.col("line").between(1, self.rows - 1))
        return some.select("file", "line", F.posexplode("fields").alias("column", "text")).where(F.col("column") >= self.cols)

    def row_annotations(self) -> DataFrame:
        """``(file, row, column, text)`` of the annotation columns; a missing field is the empty text."""
        each = F.transform(F.sequence(F.lit(0), F.lit(self.cols - 1)), lambda k: F.coalesce(F.get("fields", k), F.lit("")))
        return self.body().select("file", "row", F.posexplode(each).alias("column", "text"))

    def body(self) -> DataFrame:
        """``(file, row, fields)`` of the lines below the annotation rows, numbered from 0."""
        return self.lines.where(F.col("line") >= self.rows).select("file", (F.col("line") - self.rows).alias("row"), "fields")

    def keys(self, key: str | int) -> DataFrame:
        """``(file, row, key)``: the field of a column given by name, looked up in each file's own header, or by position (from 0)."""
        body = self.body()
        if isinstance(key, int):
            return body.select("file", "row", cell(F.col("fields"), key).alias("key"))
        place = self.header().where(F.col("name") == key).groupBy("file").agg(F.min("column").alias("place"))
        return body.join(place, "file").select("file", "row", F.coalesce(F.get("fields", F.col("place")), F.lit("")).alias("key"))

    def index(self, key: str | int, numeric: bool = False) -> DataFrame:
        """``(file, rank, key, row)``: each file's rows in the order of the key, ties by row; with ``numeric`` by its number, texts that are none at the end."""
        order: list[Column] = [F.col("key"), F.col("row")]
        if numeric:
            order = [numeric_text(F.col("key")).asc_nulls_last(), *order]
        return self.keys(key).select("file", (F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1).alias("rank"), "key", "row")

    def scores(self) -> DataFrame:
        """``(file, i, j, v)``: the numbers right of the annotation columns; other texts and missing fields have no cell."""
        cells = self.body().select("file", F.col("row").alias("i"), F.posexplode("fields").alias("j", "text")).where(F.col("j") >= self.cols)
        return cells.select("file", "i", (F.col("j") - self.cols).cast("long").alias("j"), numeric_text(F.col("text")).alias("v")).where("v is not null")


def read_annotated(spark: SparkSession, path: str, rows: int = 1, cols: int = 1, sep: str = "\t") -> AnnotatedTable:
    return AnnotatedTable(numbered_lines(spark, path, sep), rows, cols)
