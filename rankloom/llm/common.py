"""What the corpus operators share: tables, the shared scratch folder, bounded samples and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: a batch of whole texts stays small next to a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small from here on; a session that asks for still smaller ones keeps them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("b") or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only where it is unset and one machine does all the work, as in
    tests, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and lost executors take nothing with them."""
    path = f"{shared_folder(df.sparkSession)}/rankloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Names like these that no column of df has, so that helper columns cannot meet the table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]


def hash_share(key: Column, wanted: int, total: int) -> Column:
    """A filter that keeps about ``wanted`` of ``total`` rows by the hash of a key, alike in every run."""
    slots = 1 << 30
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("share")), F.lit(slots)) < int(min(1.0, wanted / max(total, 1)) * slots)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def arrow_map(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow with make(batch) -> RecordBatch for every batch that has rows."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return df.mapInArrow(run, schema)
