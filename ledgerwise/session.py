"""Session helpers: a local session for tests and benches, and staged tables."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on.

    Normalization is one long chain of wide projections. Fused into a single generated method it
    passes the 8000 bytecodes above which the JVM no longer compiles it, and runs interpreted. Two
    limits keep it apart: steps of more than 48 columns are compiled projection by projection at
    once, and so is any other stage whose method grows too long. All others stay fused.
    """
    spark.conf.set("spark.sql.codegen.maxFields", "48")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores; larger inputs pass unchanged.

    Without this a small single-split file would be normalized by one task. An input that has
    enough splits, as any large one, is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session may do without it: there one machine holds driver and executors.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="ledgerwise-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the files.

    For frames that several later branches read: each branch then scans only its own columns,
    and a lost executor costs a re-read instead of a recomputation.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the folder of a staged frame once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)
