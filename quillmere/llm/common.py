"""What the operators share: inputs, lineage cuts, Arrow batches as flat bytes, distributed ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmere.shipping import ship
from quillmere.sources.shared import cut_lineage, fresh_path

#: Bytes of text that one numpy pass works on: its temporaries, a small multiple, stay in the cache.
CHUNK_BYTES = 1 << 16
#: Stands for a null document id: it sorts after every other.
NULL_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(id_col: str = "doc_id") -> Column:
    """The id as a long; a null id sorts last, so it never counts as the smaller document."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to hand freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and would keep their high-water mark."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def arrow_map(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow, on executors that have this package; a task's end gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of the column each; a row is never cut.

    A batch has a bounded number of rows, but rows of any length.
    """
    _, bounds = flat(batch.column(column))
    row = 0
    while row < len(batch):
        end = min(len(batch), max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1))
        yield batch.slice(row, end - row)
        row = end


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """The UTF-8 bytes of a column: what numbers of buckets are derived from, in place of any setting."""
    return int(df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def binary_column(column: pa.Array) -> pa.LargeBinaryArray:
    """A string or binary column as large binary; null becomes empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column: row i is bytes[offsets[i]:offsets[i + 1]]."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = binary_column(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0), of about `most` bytes each; a row is never cut."""
    raw, bounds = flat(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        end = min(end, rows)
        yield row, end, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def global_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_task: int = 50_000) -> DataFrame:
    """Adds `out`: the row's number from 0 among the rows of its keys.

    A key may hold any share of the rows: it is dealt over sub-buckets by a hash of the order
    columns, rows are numbered within a sub-bucket, and the counts of the sub-buckets before it
    are added. Rows equal in all order columns are interchangeable. df is read twice.
    """
    total = df.count()
    subs = max(1, -(-total // rows_per_task))
    df = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(subs)))
    counts = df.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_sub").orderBy(*order)) - 1
    ranked = df.withColumn("_in", inside).join(offsets, [*keys, "_sub"])
    return ranked.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_sub", "_in", "_before")
