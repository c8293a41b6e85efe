"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the white-space tokenisers: anything between the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch: whole texts of any length go through Python in such portions.
BATCH_BYTES = 4 << 20


def bounded_batches(query):
    """Run a query or stage with Arrow batches bounded by bytes; memory per task is then the same for short and long texts."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def whole(column: Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def hex_digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from the columns there are."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(lengths, limit: int):
    """Cut consecutive rows into runs (start, stop) whose lengths sum to at most ``limit``, or of one row."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start = i
            total = 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
