"""Exact duplicates by recipes of content-defined chunks. DataFrame functions only.

A text is cut where its content says so: after 256 code points at the next mark, at the latest after 4096. A mark is a
vowel, l, n or r, a space and a letter c to g, or a line feed before b to g, or the end of a CJK sentence: places some hundred
characters apart, so that a passage two texts share falls into the same chunks a few chunks after its start. Equal texts are
cut alike. The text's recipe is the ordered list of its chunks' identifiers.

* *Identifiers are verified.* A chunk's two 64-bit hashes name it. All distinct (hashes, chunk) pairs are found by one
  aggregation whose partial step drops repeats in each task, so a chunk moves at most once per task that holds it, and
  a chunk in a third of all texts is one row per task. Hashes that stand for two contents are doubtful; their chunks are
  numbered in order of content and the number becomes part of the identifier. So equal identifiers mean equal bytes.
* *Texts never move.* Recipes are made beside the scan and written with the id and a digest: about 4 % of the text.
  Grouping, comparison and the join back work on these rows.
* *Groups.* One aggregation by recipe with fixed-width buffers, one row per task and group. Only groups of several rows
  are written and joined back; adaptive execution splits the join's partition of a group with very many rows.

Of equal texts the row with the largest doc_id stays. Edge cases: a NULL text equals the empty one; a NULL id is smaller
than any other; of repeated rows with the largest id exactly one stays; only doc_id and text are read. A text is one value of
one task, like its chunks.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, id_and_text, written

#: 256 code points, then up to the first mark, 4096 in all; a rest without one is a chunk.
CHUNK = r"(?s).{256}.{0,3836}?(?:[aeiou][lnr]\x20[c-g]|\n[b-g]|[。！？])|.{1,4096}"
SMALLEST = -(2**63)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def two_hashes(chunk: Column) -> list[Column]:
    return [F.xxhash64(chunk), F.xxhash64(F.lit(1), chunk)]


Hashes = Callable[[Column], list[Column]]


def _texts(docs: DataFrame) -> DataFrame:
    rows = id_and_text(docs).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
                       chunks_of(F.col("text")).alias("chunks"))


def distinct_chunks(docs: DataFrame, hashes: Hashes = two_hashes) -> DataFrame:
    """Every different chunk once, with its hashes a and b."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a, b = hashes(F.col("chunk"))
    return docs.select(F.explode(chunks_of(text)).alias("chunk")).select(a.alias("a"), b.alias("b"), "chunk").distinct()


def doubtful_hashes(chunks: DataFrame) -> DataFrame:
    """Hashes that stand for several contents."""
    return chunks.groupBy("a", "b").count().filter("count > 1").select("a", "b")


def recipes(docs: DataFrame, hashes: Hashes = two_hashes) -> DataFrame:
    """row, doc_id, text_sha256 and the recipe of every text, as a written table."""
    chunks = distinct_chunks(docs, hashes)
    doubtful = written(doubtful_hashes(chunks), "doubtful-chunks")
    if doubtful.isEmpty():
        drop_written(doubtful)
        named = F.transform("chunks", lambda c: F.struct(*(h.alias(n) for h, n in zip(hashes(c), "ab"))))
        return written(_texts(docs).select("row", "doc_id", "text_sha256", named.alias("recipe")), "recipes")
    order = Window.partitionBy("a", "b").orderBy("chunk")
    numbered = chunks.join(doubtful, ["a", "b"], "left_semi").withColumn("number", F.row_number().over(order))
    a, b = hashes(F.col("chunk"))
    pieces = _texts(docs).select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk"))
    pieces = pieces.withColumns({"a": a, "b": b}).join(numbered, ["a", "b", "chunk"], "left")
    named = F.struct("pos", "a", "b", F.coalesce("number", F.lit(0)).alias("number"))
    made = pieces.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(named)).alias("recipe"))
    made = written(made, "recipes")
    drop_written(doubtful)
    return made


def exact_duplicates(docs: DataFrame, hashes: Hashes = two_hashes) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    made = recipes(docs, hashes).withColumn("digest", F.xxhash64("recipe"))
    groups = made.groupBy("digest", "recipe").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("largest"),
        F.max_by("row", F.coalesce("doc_id", F.lit(SMALLEST))).alias("keep_row"))
    several = written(groups.filter("n > 1"), "copies")
    joined = made.join(several, ["digest", "recipe"], "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("largest")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
