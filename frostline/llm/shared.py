"""Reading tables, and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.storage import new_path, removed, shared_dir, written

__all__ = ["batched", "in_batches", "let", "new_path", "removed", "shared_dir", "table", "texts_of", "written"]

#: What Spark sends to Python at once. Rows of long texts make batches large, so bytes bound them too.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once. Lambdas of higher-order functions compute what they take from
    outside for each element, unless it is a column or, as here, an element itself."""
    return F.transform(F.array(value), body)[0]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def in_batches(rows: Iterator[tuple], names_types: list[tuple[str, pa.DataType]], size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    schema = pa.schema(names_types)

    def made(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield made(part)
            part = []
    if part:
        yield made(part)
