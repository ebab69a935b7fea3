"""Fill-in-middle examples, cut by line or by code point through a sparse index of multibyte characters.

A text is handled as its UTF-8 bytes. `PointIndex` records the multibyte characters alone: their code-point
positions and the bytes they take beyond one, summed up. A cut is turned from code points to bytes, or back, by one
binary search in these; between two such characters, and in a text of ASCII only, the conversion is plain arithmetic.

``fill_in_middle`` cuts every text in three at two drawn places and writes it in one of two orders:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

The draws are the first four 8-digit groups of the hex sha256 of ``seed:doc_id``: two cuts among the n + 1 borders of n
units, whether the text is rearranged at all, and the order. Equal cuts leave the middle empty.

Edge cases: a NULL text is empty; an empty text, and one that contains a mark, stays plain (its cuts are NULL); a NULL id
is drawn for as the empty id; repeated rows give the same example each; columns other than doc_id and text are not read.
A continuation byte without a lead (no valid UTF-8) counts to the character before it. A text is one value of one task;
batches of results are cut by size, so long texts are never gathered.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
BATCH_BYTES = 4 << 20


class PointIndex:
    """Where a text's multibyte characters are, and how many bytes beyond one they take up to each."""

    def __init__(self, data: bytes):
        self.size = len(data)
        self.at = self.lead = self.excess = np.zeros(0, np.int64)
        if not data.isascii():
            trails = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80
            trails[:1] = False
            trailing = np.flatnonzero(trails)
            first = np.flatnonzero(np.diff(trailing, prepend=-2) != 1)
            self.lead = trailing[first] - 1
            before = first  # every trailing byte before a character's own was one beyond
            self.excess = np.append(first[1:], trailing.size) if first.size else self.excess
            self.at = self.lead - before
        self.points = self.size - (int(self.excess[-1]) if self.excess.size else 0)

    def to_byte(self, point: int) -> int:
        k = int(np.searchsorted(self.at, point, "left"))
        return point + int(self.excess[k - 1]) if k else point

    def to_point(self, byte: int) -> int:
        """``byte`` is a border between two characters."""
        k = int(np.searchsorted(self.lead, byte, "left"))
        return byte - int(self.excess[k - 1]) if k else byte


def line_ends(data: bytes) -> np.ndarray:
    """The byte after each line; a last line may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def cut(data: bytes, index: PointIndex, unit: str, draws: tuple[int, int]) -> tuple[int, int, int]:
    """Number of units, and the bytes at which prefix and middle end."""
    if unit == "char":
        n = index.points
        low, high = sorted(d % (n + 1) for d in draws)
        return n, index.to_byte(low), index.to_byte(high)
    ends = line_ends(data)
    n = len(ends)
    low, high = sorted(d % (n + 1) for d in draws)
    return n, *(int(ends[k - 1]) if k else 0 for k in (low, high))


def arrange(data: bytes, first: int, second: int, order: str) -> bytes:
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    parts = (PREFIX, prefix, SUFFIX, suffix) if order == "psm" else (SUFFIX, suffix, PREFIX, prefix)
    return b"".join((*parts, MIDDLE, middle))


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an example. Its parts hold no mark, and a mark cannot begin inside a part and end in a mark."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    left, _, rest = output[len(PREFIX):].partition(inner)
    right, _, middle = rest.partition(MIDDLE)
    return left + middle + right if form == "psm" else right + middle + left


def _in_pieces(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their weight in bytes, as batches of about BATCH_BYTES."""
    held, weight = [], 0
    for size, row in rows:
        held.append(row)
        weight += size
        if weight >= BATCH_BYTES or len(held) >= 10000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the example as ``output``.

    ``unit`` is ``line`` or ``char``, ``rate`` and ``spm`` are percentages of the rearranged and, among them, the spm form.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("_drawn", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = id_and_text(docs).withColumn("_drawn", drawn).select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *numbers)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.binary())])

    def examples(batches):
        for batch in batches:
            for doc_id, data, h1, h2, h3, h4 in zip(*(c.to_pylist() for c in batch.columns)):
                index = PointIndex(data)
                n, first, second = cut(data, index, unit, (h1, h2))
                if not data or any(m in data for m in MARKS) or h3 % 100 >= rate:
                    yield len(data), (doc_id, n, "plain", None, None, data)
                    continue
                order = "spm" if h4 % 100 < spm else "psm"
                prefix, both = index.to_point(first), index.to_point(second)
                yield len(data), (doc_id, n, order, prefix, both - prefix, arrange(data, first, second, order))

    made = rows.mapInArrow(lambda batches: _in_pieces(examples(batches), schema),
                           "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame) -> DataFrame:
    """The columns of ``made`` with ``restored``, the text rebuilt from output and form alone."""
    names = [n for n in made.columns if n != "output"]
    rows = made.select(*names, F.col("output").cast("binary").alias("output"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", restored binary"

    def texts(batches):
        for batch in batches:
            forms, outputs = batch.column("form").to_pylist(), batch.column("output")
            texts = pa.array([rebuild(o.as_py(), f) for o, f in zip(outputs, forms)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "restored"])

    return rows.mapInArrow(texts, schema).withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def digests(made: DataFrame) -> DataFrame:
    """Digests of the examples and of the texts rebuilt from them."""
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("restored", 256).alias("restored_sha256"))
