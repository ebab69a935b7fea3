"""Helpers of the text operators: appended columns, bounded caches, shared intermediate tables."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_folder

WORD_SPACES = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id BIGINT and text, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % parts


def append_columns(
    df: DataFrame, added: str, compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """``df`` with further columns from ``compute``, which maps batches to longer batches."""
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    return df.mapInArrow(compute, schema)


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    names = batch.schema.names + list(columns)
    return pa.RecordBatch.from_arrays(list(batch.columns) + [_array(c) for c in columns.values()], names=names)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(name).to_pylist()


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of up to ``size`` bytes of text each; a longer text goes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class BoundedCache(dict):
    """A dict that computes missing values and is emptied when full, so a worker stays small."""

    def __init__(self, compute: Callable, limit: int, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, a lost executor costs a read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through Hadoop's file system, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a table from ``written`` that no later result reads."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)
