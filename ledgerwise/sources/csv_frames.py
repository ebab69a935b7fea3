"""Strict CSV records of large files, read by splits: line breaks inside quotes are found without reading a file in one task.

Rules: fields part at commas; a field that begins with a quote ends with one, quotes inside are doubled, and only a comma or
the line's end follows; in any other field a quote is a character like others; a record ends at a line feed outside
quotes, with or without a carriage return before it; empty lines are no records. Anything else is an error.

A line maps the state before it (outside or inside a quoted field) to the state after it. ``split_states`` composes the lines
of each split in the scanning task, for both states, and the splits of each file by running sums; so every split's first state
is known although the tasks never talk. Only lines with a quote reach Python there. ``framed`` then cuts each split into
records and parses them; the pieces of a record that crosses a border (at most two a split) are put together afterwards.
"""

import csv
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT, IN, BROKEN = 0, 1, 2

_REST = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:"{_REST}"|[^",\r][^,\r]*+|)'
#: Before the line: outside, inside. After it: outside, inside; otherwise the line is broken.
_MOVES = {
    OUT: ((OUT, re.compile(rf"{_FIELD}(?:,{_FIELD})*+\r?")), (IN, re.compile(rf'(?:{_FIELD},)*+"{_REST}'))),
    IN: ((OUT, re.compile(rf'{_REST}"(?:,{_FIELD})*+\r?')), (IN, re.compile(rf'{_REST}(?:"(?:,{_FIELD})*,"{_REST})?'))),
}


def after_line(state: int, line: str) -> int:
    if state == BROKEN or '"' not in line:
        return state
    return next((end for end, form in _MOVES[state] if form.fullmatch(line)), BROKEN)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines as Spark splits the files, in order within each split; carriage returns stay."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def split_states(lines: DataFrame) -> DataFrame:
    """_file, _block, first and last: the states at both ends of every split that holds a quote."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*at, *ends), (pa.string(), pa.int64(), pa.int32(), pa.int32()))],
                names=["_file", "_block", "from_out", "from_in"])

        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            for file, block, value in zip(*(c.to_pylist() for c in columns)):
                if at != (file.decode(), block):
                    if at is not None:
                        yield row()
                    at, ends = (file.decode(), block), (OUT, IN)
                # Bytes that are no UTF-8 are reported when the line is parsed; here only quotes and commas count.
                line = value.decode("latin-1")
                ends = tuple(after_line(state, line) for state in ends)
        if at is not None:
            yield row()

    quoted = lines.filter(F.contains("value", F.lit('"')))
    splits = quoted.mapInArrow(composed, "_file string, _block bigint, from_out int, from_in int")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    # The last split that ends alike from both states decides; since then only exchanges of the two count.
    fixed, swaps = F.col("from_out") == F.col("from_in"), (F.col("from_out") == IN) & (F.col("from_in") == OUT)
    # Broken from one state only: that state would be an error, so it counts as never held.
    either = F.when(F.col("from_out") == BROKEN, F.col("from_in")).when(F.col("from_in") == BROKEN, F.col("from_out"))
    df = splits.withColumn("set", F.when(fixed, F.col("from_out")).otherwise(either)).withColumn("exchanges", F.sum(swaps.cast("int")).over(upto))
    df = df.withColumn("at_set", F.when(F.col("set").isNotNull(), F.col("exchanges")))
    held = F.coalesce(F.last("set", True).over(before), F.lit(OUT))
    since = F.coalesce(F.lag("exchanges").over(Window.partitionBy("_file").orderBy("_block")), F.lit(0)) - F.coalesce(
        F.last("at_set", True).over(before), F.lit(0))
    first = F.when(held == BROKEN, F.lit(BROKEN)).otherwise((held + since) % 2).cast("int")
    df = df.withColumn("first", first)
    last = F.when(F.col("first") == OUT, F.col("from_out")).when(F.col("first") == IN, F.col("from_in")).otherwise(F.lit(BROKEN))
    return df.select("_file", "_block", "first", last.cast("int").alias("last"))


def inside_ranges(states: DataFrame) -> DataFrame:
    """Per file the ranges of splits that begin inside quotes: (after, upto], at most one row a split.

    A split without quotes keeps the state of the last one with quotes before it.
    """
    order = Window.partitionBy("_file").orderBy("_block")
    ranges = states.select("_file", F.col("_block").alias("after"), F.lead("_block").over(order).alias("upto"), "last")
    return ranges.filter(F.col("last") == IN).select(F.col("_file").alias("in_file"), "after", "upto")


def _records(values: list[str], begun: list[str] | None) -> tuple[list[str], list[str] | None]:
    """Lines to whole records. ``begun`` are the lines so far of a record that began before, and of the one that is left open."""
    whole = []
    for line in values:
        if begun is None and '"' not in line:
            whole.append(line)
            continue
        state = after_line(OUT if begun is None else IN, line)
        begun = [] if begun is None else begun
        begun.append(line)
        if state != IN:  # a broken record is reported by the parser
            whole.append("\n".join(begun))
            begun = None
    return whole, begun


def _schema(width: int) -> pa.Schema:
    names = [f"c{i}" for i in range(width)]
    return pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("_seq", pa.int64()), ("_piece", pa.string()),
                      ("_error", pa.string()), *[(n, pa.string()) for n in names]])


def _types(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _parse(records: list[str], width: int) -> Iterator[tuple[list[str], str | None]]:
    """The fields of each record that is not an empty line, or why it is none."""
    blank = [None] * width
    csv.field_size_limit(2**31 - 1)
    for record in records:
        try:
            rows = list(csv.reader([record], strict=True))
        except csv.Error as error:
            yield blank, f"malformed record: {error}"
            continue
        for row in rows:
            if row:
                yield (row, None) if len(row) == width else (blank, "a record has the wrong number of fields")


def framed(given: DataFrame, states: DataFrame, header: list[str]) -> DataFrame:
    """_file, _block, _seq, the fields c0, c1, ... and, for what is no record, _error; pieces of records have _piece.

    ``given`` is ``lines``, ``states`` their ``split_states``, ``header`` what each file must begin with. Lines of one split are
    parsed in order, a batch at a time.
    """
    ranges = inside_ranges(states)
    inside = (F.col("_file") == F.col("in_file")) & (F.col("_block") > F.col("after")) & F.coalesce(F.col("_block") <= F.col("upto"), F.lit(True))
    # At most one row a split, a millionth of the data.
    located = given.join(F.broadcast(ranges), inside, "left").select("_file", "_block", F.col("in_file").isNotNull().alias("_inside"), "value")
    width = len(header)
    schema, no_fields = _schema(width), [None] * width

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, begun, first_piece = None, 0, None, False

        def left_open():
            """The record begun at the split's end, or a split wholly inside one."""
            return [(*at, -1 if first_piece else seq, "\n".join(begun), None, *no_fields)] if begun else []

        for batch in batches:
            rows = []
            files, blocks, insides = (batch.column(c).to_pylist() for c in ("_file", "_block", "_inside"))
            try:
                values = batch.column("value").to_pylist()
            except UnicodeDecodeError:
                yield _batch([(files[0], blocks[0], -2, None, "not valid UTF-8", *no_fields)], schema)
                continue
            for key, group in groupby(range(len(values)), lambda i: (files[i], blocks[i])):
                places = list(group)
                own = values[places[0] : places[-1] + 1]
                if key != at:
                    rows += left_open()
                    at, seq, first_piece = key, 0, insides[places[0]]
                    begun = [] if first_piece else None
                    if key[1] == 0 and list(_parse([own.pop(0).removeprefix("\ufeff")], width)) != [(header, None)]:
                        rows.append((*key, -2, None, "another header than the first file", *no_fields))
                whole, begun = _records(own, begun)
                if first_piece and whole:
                    rows.append((*key, -1, whole.pop(0), None, *no_fields))
                    first_piece = False
                for fields, error in _parse(whole, width):
                    rows.append((*key, seq, None, error, *fields))
                    seq += 1
            if rows:
                yield _batch(rows, schema)
        if rows := left_open():
            yield _batch(rows, schema)

    return located.mapInArrow(parsed, _types(schema))


def joined_pieces(pieces: DataFrame, width: int) -> DataFrame:
    """The records whose pieces lie in several splits, parsed; each is numbered where it began."""
    order = Window.partitionBy("_file").orderBy("_block", "_seq")
    begins = (F.col("_seq") >= 0).cast("int")
    numbered = pieces.withColumn("record", F.sum(begins).over(order))
    whole = numbered.groupBy("_file", "record").agg(
        F.min("_block").alias("_block"), F.max("_seq").alias("_seq"), F.sort_array(F.collect_list(F.struct("_block", "_seq", "_piece"))).alias("all"))
    texts = whole.select("_file", "_block", "_seq", F.array_join(F.transform("all", lambda p: p["_piece"]), "\n").alias("_piece"))
    schema = _schema(width)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, block, seq, None, error, *fields) for file, block, seq, text in zip(*(c.to_pylist() for c in batch.columns))
                    for fields, error in _parse([text], width)]
            if rows:
                yield _batch(rows, schema)

    return texts.mapInArrow(parsed, _types(schema))
