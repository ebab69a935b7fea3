"""Ledger import: build all tables in a new run folder, check them, then make the run current.

A run becomes current by entry n + 1 of the log, a file that is put there only if it is absent: of two imports that began
at entry n one fails. With every run goes a manifest, rows and content digest of each table, by which a changed cell is found.
"""

import uuid
from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..session import prepare, remove_folder
from ..sources.ledger_csv import read_ledger, source_files, source_sha256
from .ledger import Ledger

PUBLISHED = [
    "raw_records", "normalized", "groups", "invoices", "record_verdicts", "invoice_sources", "quarantine",
    "quarantine_rows", "account_marks", "accounts", "quality_issues", "report",
]


_BETWEEN, _NOTHING = chr(31), chr(30)
# Marks the digests of a manifest; those of runs from before have none and are sums of MD5 prefixes.
_XXH64 = "xxh64:"


def _text(value: Column, kind: DataType) -> Column:
    if isinstance(kind, ArrayType):
        parts = F.transform(value, lambda x: _text(x, kind.elementType))
        found = F.concat(F.lit("["), F.array_join(parts, _BETWEEN), F.lit("]"))
    elif isinstance(kind, StructType):
        parts = [_text(value[f.name], f.dataType) for f in kind.fields]
        found = F.when(value.isNotNull(), F.concat(F.lit("("), F.concat_ws(_BETWEEN, *parts), F.lit(")")))
    else:
        found = value.cast("string")
    return F.coalesce(found, F.lit(_NOTHING))


def _total(number: Column) -> Column:
    """The sum of BIGINTs as text. Both halves are summed as BIGINT: a DECIMAL sum makes an object of every row."""
    high, low = F.shiftright(number, 32), number.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    total = F.sum(high).cast("decimal(20,0)") * F.lit(Decimal(1 << 32)).cast("decimal(10,0)") + F.sum(low).cast("decimal(20,0)")
    return F.coalesce(total.cast("string"), F.lit("0"))


def digest_of(df: DataFrame, columns: list[str] | None = None) -> Column:
    """An aggregate: a sum of row hashes over all columns by name, the same in any order of the rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = F.concat_ws(_BETWEEN, *[_text(F.col(c), kinds[c]) for c in sorted(columns or df.columns)])
    hashed = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return _total(hashed).alias("digest")


def _cells(value: Column, kind: DataType) -> list[Column]:
    """What is hashed of a value. A hash passes over NULL, so that is a cell of its own; arrays go in as text."""
    if isinstance(kind, StructType):
        return [value.isNull(), *[cell for f in kind.fields for cell in _cells(value[f.name], f.dataType)]]
    if isinstance(kind, ArrayType):
        return [F.when(F.size(value) == 0, F.lit("[]")).otherwise(_text(value, kind))]
    if isinstance(kind, MapType):
        return _cells(F.array_sort(F.map_entries(value)), ArrayType(StructType().add("key", kind.keyType).add("value", kind.valueType)))
    return [value.isNull(), value]


def content_sum(df: DataFrame) -> Column:
    """An aggregate: a sum of 64-bit row hashes over all columns by name, nested ones too, the same in any order of the rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = F.xxhash64(*[cell for c in sorted(df.columns) for cell in _cells(F.col(c), kinds[c])])
    return F.concat(F.lit(_XXH64), _total(row)).alias("digest")


def manifest(tables: dict[str, DataFrame], digest: Callable[[DataFrame], Column] = content_sum) -> DataFrame:
    """table_name, n_rows and digest of each table."""
    rows = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), digest(df)) for name, df in sorted(tables.items())]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """The names in the log; they count up."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(n for n in (entry.getPath().getName() for entry in found) if n.isdigit())


def _append(spark: SparkSession, folder: str, run: str, number: int) -> None:
    """Put entry ``number`` into the log unless it is there; the entry appears with its content or not at all."""
    hadoop = spark._jvm.org.apache.hadoop
    name, draft = f"{folder}/log/{number:020d}", f"{folder}/runs/{run}/entry"
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.text(draft)
    written = hadoop.fs.Path(draft)
    files = written.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(written) if s.getPath().getName().startswith("part-"))
    files.mkdirs(hadoop.fs.Path(f"{folder}/log"))
    keep = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(part), files.makeQualified(hadoop.fs.Path(name)), keep)
    except Exception as error:
        if files.exists(hadoop.fs.Path(name)):
            raise ValueError(f"another import became entry {number} of the log meanwhile") from error
        raise


def publish(
    spark: SparkSession, raw: DataFrame, folder: str, as_of: str | None = None, sha256: str | None = None
) -> Ledger:
    """Write every table under a new run, check all constraints, then put the run into the log.

    The log entry is one small file and the last step: a reader sees the previous run until then,
    and an import that fails anywhere before, or is overtaken by another one, leaves it current.
    """
    if as_of is not None:
        as_of = date.fromisoformat(as_of).isoformat()
    prepare(spark)
    entries = _entries(spark, folder)
    number = int(entries[-1]) + 1 if entries else 1
    run = uuid.uuid4().hex
    entry: dict[str, Observation] = {}

    def save(label: str, df: DataFrame) -> DataFrame:
        # The manifest's entry is summed over the rows as they are written, so no table is read again for it.
        path, entry[label] = f"{folder}/runs/{run}/{label}", Observation()
        df.observe(entry[label], F.count(F.lit(1)).alias("n_rows"), content_sum(df)).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ledger = Ledger(raw, as_of, save, None if sha256 is None else F.lit(sha256))
    try:
        _check(ledger, as_of)
        found = [(name, entry[name].get["n_rows"], entry[name].get["digest"]) for name in sorted(PUBLISHED)]
        made = spark.createDataFrame(found, "table_name string, n_rows bigint, digest string")
        made.coalesce(1).write.parquet(f"{folder}/runs/{run}/manifest")
        _append(spark, folder, run, number)
    except Exception:
        remove_folder(spark, f"{folder}/runs/{run}")
        raise
    return ledger


def _check(ledger: Ledger, as_of: str | None) -> None:
    """Write all tables; refuse a ledger that breaks any of the fixed rules."""
    if as_of is None and ledger.invoices.isEmpty():
        raise ValueError("no accepted invoices; give an as-of date to publish an audit-only ledger")
    broken = ledger.violations().filter("n > 0").orderBy("rule").collect()
    if broken:
        raise ValueError("constraints violated: " + ", ".join(f"{r['rule']} ({r['n']})" for r in broken))
    ledger.report


def import_csv(spark: SparkSession, path: str, folder: str, as_of: str | None = None) -> Ledger:
    """Import ledger CSV files and publish the result."""
    if folder.rstrip("/") == path.rstrip("/"):
        raise ValueError("output must not overwrite the source CSV")
    raw = read_ledger(spark, path)
    sha256 = source_sha256(source_files(spark, path)).head()[0]
    return publish(spark, raw, folder, as_of, sha256)


def current_run(spark: SparkSession, folder: str) -> str:
    """The folder of the run that the last log entry names."""
    entries = _entries(spark, folder)
    if not entries:
        raise ValueError("nothing has been published here")
    return f"{folder}/runs/{spark.read.text(f'{folder}/log/{entries[-1]}').head()['value']}"


def read_published(spark: SparkSession, folder: str, verify: bool = False) -> dict[str, DataFrame]:
    """All tables of the current run. ``verify`` reads them once and fails if one is not what was published."""
    run = current_run(spark, folder)
    tables = {name: spark.read.parquet(f"{run}/{name}") for name in PUBLISHED}
    if verify:
        entries = spark.read.parquet(f"{run}/manifest")
        earlier = entries.filter(~F.startswith("digest", F.lit(_XXH64))).head() is not None
        found = manifest(tables, digest_of if earlier else content_sum).select("table_name", F.struct("n_rows", "digest").alias("found"))
        given = entries.select("table_name", F.struct("n_rows", "digest").alias("given"))
        changed = found.join(given, "table_name", "full_outer").filter(~F.col("found").eqNullSafe(F.col("given")))
        names = [r["table_name"] for r in changed.orderBy("table_name").collect()]
        if names:
            raise ValueError("published tables have changed: " + ", ".join(names))
    return tables
