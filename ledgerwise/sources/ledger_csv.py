"""Ledger CSV files: header check, landing with stable row numbers, and fingerprints."""

import csv
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..policies import LEDGER_COLUMNS
from ..session import stage
from .csv_frames import BROKEN, IN, framed, joined_pieces, lines, split_states

FIRST_SOURCE_ROW = 2


def ledger_header(spark: SparkSession, path: str) -> list[str]:
    """The header of a file: the 19 columns, once each, in any order. All files must have the same."""
    first = lines(spark, path).select("value").head()
    header = next(csv.reader([first["value"].removeprefix("\ufeff")]), []) if first else []
    if len(header) != len(LEDGER_COLUMNS) or set(header) != set(LEDGER_COLUMNS):
        raise ValueError("the ledger header must name each of the 19 columns once")
    return header


def _refuse_first(problems: DataFrame) -> None:
    """Fail on the first problem, if there is one. ``problems`` has _file, _block, _seq and _error."""
    first = problems.filter(F.col("_error").isNotNull()).agg(F.min(F.struct("_file", "_block", "_seq", "_error")).alias("p")).head()["p"]
    if first is not None:
        raise ValueError(f"{first['_error']} in {first['_file']}, split at byte {first['_block']}")


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All-text records as written, with ``_file``, ``_block`` and ``_seq``, landed as Parquet.

    Files of any size are read by splits, line breaks in quotes or not. Malformed quoting, a record of the wrong width and
    bytes that are not UTF-8 fail the load; empty lines are skipped.
    """
    header = ledger_header(spark, path)
    given = lines(spark, path)
    states = stage(split_states(given), "split-states")
    open_end = states.groupBy("_file").agg(F.max("_block").alias("_block"), F.max_by("last", "_block").alias("last")).filter(F.col("last") == IN)
    broken = states.filter(F.col("last") == BROKEN).select("_file", "_block")
    _refuse_first(open_end.select("_file", "_block", F.lit(0).alias("_seq"), F.lit("malformed record: unexpected end of data").alias("_error")).unionByName(
        broken.select("_file", "_block", F.lit(0).alias("_seq"), F.lit("malformed record: a quote inside a quoted field").alias("_error"))))
    landed = stage(framed(given, states, header), "landed")
    _refuse_first(landed)
    records, pieces = landed.filter(F.col("_piece").isNull()), landed.filter(F.col("_piece").isNotNull())
    if not pieces.isEmpty():
        joined = stage(joined_pieces(pieces, len(header)), "joined")
        _refuse_first(joined)
        records = records.unionByName(joined)
    fields = [F.col(f"c{i}").alias(name) for i, name in enumerate(header)]
    return records.select("_file", "_block", "_seq", *fields)


def natural_order(path: Column) -> Column:
    """A sort key in which numbers inside the path compare by value: part-99999 before part-100000."""
    parts = F.split(path, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")

    def key(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return F.when(part.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits).cast("string"), 3, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, key), "")


def number_rows(landed: DataFrame) -> DataFrame:
    """Add source_row: 2, 3, ... over files in natural path order and records in file order.

    ``landed`` has ``_file``, ``_block`` and ``_seq``, consecutive within a block. Offsets are summed over
    files, one row each, and within each file over its blocks.
    """
    blocks = landed.groupBy("_file", "_block").agg(F.min("_seq").alias("first"), F.count("*").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda order: F.coalesce(F.sum("n").over(order), F.lit(0))
    files = blocks.groupBy("_file").agg(F.sum("n").alias("n")).withColumn("_key", natural_order(F.col("_file")))
    ahead = files.select("_file", running(before.orderBy("_key", "_file")).alias("ahead"))
    inside = blocks.select("_file", "_block", "first", running(before.partitionBy("_file").orderBy("_block")).alias("within"))
    shifts = inside.join(ahead, "_file").select(
        "_file", "_block", (F.col("ahead") + F.col("within") - F.col("first")).alias("shift"))
    numbered = landed.join(shifts, ["_file", "_block"])
    source_row = F.col("_seq") + F.col("shift") + FIRST_SOURCE_ROW
    return numbered.select(source_row.alias("source_row"), *LEDGER_COLUMNS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The records, numbered from what was landed: positions depend on how the input was split, so they are never computed again."""
    landed = scan_ledger(spark, path)
    if landed.isEmpty():
        raise ValueError("the ledger has no records")
    return number_rows(landed)


def write_ledger(records: DataFrame, path: str) -> None:
    """Write records as ledger CSV files, outer white space kept."""
    records.select(*LEDGER_COLUMNS).write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


HASH_BYTES = 1 << 22


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of the files the ledger is read from; a task hashes a file piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                files, name = FileSystem.from_uri(uri if "://" in uri else uri.replace(":", "://", 1))
                digest = hashlib.sha256()
                with files.open_input_stream(name, compression=None) as given:
                    while piece := given.read(HASH_BYTES):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha256"])

    # The content column is not selected, so Spark only lists the files.
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, length bigint, sha256 string")


def source_sha256(files: DataFrame) -> DataFrame:
    """One fingerprint. One file gives its own SHA-256; several give the hash of the hashes of the
    file hashes, sorted within 256 prefixes, so no step holds all files."""
    prefixes = files.groupBy(F.substring("sha256", 1, 2).alias("prefix")).agg(
        F.count("*").alias("n"),
        F.max("sha256").alias("only"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("digest"),
    )
    parts = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
    joined = F.array_join(F.transform(parts, lambda p: p["digest"]), "")
    return prefixes.agg(
        F.when(F.sum("n") == 1, F.max("only")).otherwise(F.sha2(joined, 256)).alias("source_sha256")
    )
