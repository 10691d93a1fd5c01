"""Shared helpers: input tables, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast only when it has been counted and has at most so many rows of ids or hashes.
BROADCAST_ROWS = 2_000_000
#: Rows and bytes of a batch that a Python worker gets while an intermediate table is written.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a new temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/marlstone/{label}-{uuid.uuid4().hex}"
    with settings(spark, ARROW_BATCH):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of rows that the driver has, handed over by Arrow: no Python worker takes part."""
    fields = StructType.fromDDL(ddl).fields
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({f.name: pa.array(list(c), _ARROW[f.dataType.simpleString()]) for f, c in zip(fields, columns, strict=True)}))


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows stay within ``limit``; otherwise leave the join to shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    known = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in known:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
