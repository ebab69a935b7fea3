"""Quality rules with thresholds that adapt to language and source.

Every document gets integer measures. Their distributions are kept in mergeable quantile sketches:
counts per bucket, buckets exact up to 255 and 128 to each further power of two, so a quantile is
off by less than one part in 128 and sketches merge by adding counts, in any order, with the same
result. One sketch per language, source and measure gives the bounds of that group: the quartiles
widened by three times their distance and by a small slack. Groups with too few documents take the
merged sketch of their language, then that of all documents. Verdicts come from joining the bounds
back on language and source. All of it is DataFrame functions.

Edge cases: a null text has no words and fails the base rule; a null language or source counts as
an empty one; null ids and repeated rows are kept as rows of their own; an empty table gives an
empty table. ``measure`` adds one struct column, so columns of the input cannot clash with its
fields; ``kept_documents`` returns the input's columns only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 100
FENCE = 3
#: Measures in thousandths, and how far a bound lies beyond the fence at least.
SLACK = {"symbols": 100, "dup_lines": 350, "repeat_words": 400, "word_length": 500}
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
EXACT_BITS = 8


def measures(text: Column) -> list[dict[str, Column]]:
    """Layers of columns that end in the counts of one text; long arrays never leave their row."""
    c = F.col
    no_windows = F.expr("array()").cast("array<struct<win:string,at:int>>")
    window = F.transform(
        F.sequence(F.lit(0), c("_n") - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("win"),
            i.alias("at"),
        ),
    )
    # Equal windows lie side by side once sorted.
    repeated = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(F.get("_sorted", i + 1)["win"] == x["win"], F.lit(False))
        | F.coalesce(F.get("_sorted", i - 1)["win"] == x["win"], F.lit(False)),
    )
    # Windows at ascending positions cover three words each, less what the window before covers.
    covered = F.aggregate(
        "_repeated",
        F.struct(F.lit(-3).alias("before"), F.lit(0).cast("bigint").alias("n")),
        lambda a, at: F.struct(at.alias("before"), (a["n"] + F.least(F.lit(3), at - a["before"])).alias("n")),
        lambda a: a["n"],
    )
    return [
        {"_text": F.coalesce(text, F.lit(""))},
        {
            "_words": F.array_remove(F.split(F.translate("_text", SPACES, " " * len(SPACES)), " "), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != ""),
            "_chars": F.length(F.translate("_text", SPACES, "")).cast("bigint"),
            "_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"),
        },
        {
            "_n": F.size("_words"),
            "_n_lines": F.size("_lines").cast("bigint"),
            "_dup": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        },
        {"_sorted": F.sort_array(F.when(c("_n") >= 3, window).otherwise(no_windows))},
        {"_repeated": F.sort_array(F.transform(repeated, lambda x: x["at"]))},
        {"_covered": covered},
    ]


def measure(docs: DataFrame, name: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``name``: counts, base verdict, group and measures of each text."""
    df = docs.select(F.struct("*").alias("_row"))
    row = F.col("_row")
    layers = measures(row["text"].cast("string"))
    for layer in layers:
        df = df.withColumns(layer)
    n, covered = F.col("_n").cast("bigint"), F.col("_covered")
    thousandths = lambda part, whole: F.coalesce(F.expr(f"({part} * 1000) div nullif({whole}, 0)"), F.lit(0).cast("bigint"))
    base_failed = (n < MIN_WORDS) | (covered * 100 > n * MAX_REPEAT_PERCENT)
    found = F.struct(
        F.coalesce(row["lang"].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(row["source"].cast("string"), F.lit("")).alias("source"),
        n.alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"), covered.alias("n_repeat_words"), base_failed.alias("base_failed"),
        thousandths("_symbols", "_n").alias("symbols"), thousandths("_dup", "_n_lines").alias("dup_lines"),
        thousandths("_covered", "_n").alias("repeat_words"), thousandths("_chars", "_n").alias("word_length"),
    )
    kept = [row[c].alias(c) for c in docs.columns]
    return df.select(*kept, found.alias(name))


def bucket(value: Column) -> Column:
    """Lower edge of a value's bucket: its eight leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - EXACT_BITS, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("bigint")
    return value - value % width


def sketches(measured: DataFrame, name: str = "quality") -> DataFrame:
    """lang, source, measure, bucket, n: the sketch of each group over documents that pass the base rule."""
    q = F.col(name)
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(q[m]).alias("bucket")) for m in SLACK]))
    rows = measured.filter(~q["base_failed"]).select(q["lang"].alias("lang"), q["source"].alias("source"), values.alias("v"))
    return rows.groupBy("lang", "source", F.col("v.measure").alias("measure"), F.col("v.bucket").alias("bucket")).agg(
        F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile per group: merged sketches, cumulated over their few buckets."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("low"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("high"),
    )


def bounds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: lowest and highest value of each measure."""
    group = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select("lang", "measure", *[F.col(c).alias(f"lang_{c}") for c in ("total", "low", "high")])
    # One constant key for the sketch of all documents: four rows.
    whole = quartiles(sketch.withColumn("whole", F.lit(0)), ["whole"]).select(
        "measure", *[F.col(c).alias(f"all_{c}") for c in ("total", "low", "high")])
    joined = group.join(lang, ["lang", "measure"]).join(whole, "measure")
    pick = lambda c: F.when(F.col("total") >= MIN_GROUP, F.col(c)).when(
        F.col("lang_total") >= MIN_GROUP, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    low, high = F.col("_low"), F.col("_high")
    slack = F.element_at(F.create_map(*[F.lit(x) for item in SLACK.items() for x in item]), F.col("measure"))
    wide = joined.withColumns({"_low": pick("low"), "_high": pick("high")}).withColumn(
        "_reach", (high - low) * FENCE + slack)
    columns = []
    for m in SLACK:
        columns.append(F.max(F.when(F.col("measure") == m, low - F.col("_reach"))).alias(f"min_{m}"))
        columns.append(F.max(F.when(F.col("measure") == m, high + F.col("_reach"))).alias(f"max_{m}"))
    return wide.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it; Spark does not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def judge(measured: DataFrame, name: str = "quality", verdict: str = "kept") -> DataFrame:
    """``measured`` with the verdict: base rule passed and every measure within its group's bounds.

    The bounds are written first, so that Spark knows their size: it broadcasts them while they are
    small, without dealing out the texts, and else splits the partitions of a hot source. They are one
    struct beside the documents' columns, whatever those are called.
    """
    limits = free_name(measured, f"{name}_bounds")
    found = written(bounds(sketches(measured, name)), "quality-bounds").select(F.struct("*").alias(limits))
    q, least = F.col(name), F.col(limits)
    on = (q["lang"] == least["_lang"]) & (q["source"] == least["_source"])
    inside = ~q["base_failed"]
    for m in SLACK:
        inside = inside & F.coalesce(q[m].between(least[f"min_{m}"], least[f"max_{m}"]), F.lit(True))
    # Bounds belong to documents that passed, so a failed one may have no partner.
    return measured.join(found, on, "left").select(*[F.col(f"`{c}`") for c in measured.columns], inside.alias(verdict))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts, base verdict and verdict. Texts are measured once."""
    rows = docs.select("doc_id", "text", "lang", "source")
    measured = written(measure(rows).drop("text", "lang", "source"), "quality")
    judged = judge(measured)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in counts], "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    name, verdict = free_name(docs, "_quality_measures"), free_name(docs, "_quality_kept")
    measured = written(measure(docs, name), "quality")
    return judge(measured, name, verdict).filter(verdict).select(*docs.columns)
