"""What the operators share: scratch tables in the cluster's shared folder, and the columns they read."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only in local mode, where one machine is the cluster, an unset one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="chunklake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/chunklake-{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes an execution's shuffle files as soon as the execution ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Paths of the tables written within each open ``scratch``, innermost last.
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written within it are deleted at its end, but for those put into the list that it gives."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        paths, left = _scopes.pop(), {df._scratch for df in kept}
        for path in paths:
            if path not in left:
                _delete(spark, path)
        if _scopes:
            _scopes[-1].extend(left)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``written`` that nothing will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


def tidy(spark: SparkSession, most: float = 0.5) -> None:
    """Gives back memory that the driver's JVM holds but doesn't use.

    A step's plans, broadcasts and metrics are garbage as soon as it is written. Left alone, the heap would grow to its limit before
    they go, so it is collected once it has grown over ``most`` of that. Beside the heap, what the compiler and the hundreds of threads of
    a plan's exchanges have freed stays in the C library's pools of each thread until they are trimmed.
    """
    java = spark._jvm.java.lang
    runtime = java.Runtime.getRuntime()
    if runtime.totalMemory() > most * runtime.maxMemory():
        gc.collect()  # what Python holds of the JVM goes first
        java.System.gc()
    with suppress(Py4JError, StopIteration):  # other JVMs than HotSpot on Linux can't be asked to
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        asked = spark.sparkContext._gateway.new_array(java.Object, 4)
        asked[0], asked[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, asked)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The table's size is known when it is read again, so Spark itself decides by
    spark.sql.autoBroadcastJoinThreshold whether a join may broadcast it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scopes:
        _scopes[-1].append(path)
    return out


#: Bytes in memory up to which a table may be broadcast, where the session's threshold allows it.
BROADCAST = 32 << 20


def rows_in(table: DataFrame) -> int:
    """The number of rows of a table made by ``written``, read from its footers once."""
    if getattr(table, "_rows", None) is None:
        table._rows = table.count()
    return table._rows


def held(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df, kept from being broadcast where so many rows take more than BROADCAST in memory.

    Spark decides by sizes of compressed files, in which an array counts as one element and an exploded row as one row: so a table that
    fills the driver's heap can look smaller than the threshold, until the input is so large that even its file is not.
    """
    return df.hint("merge") if rows * row_bytes > BROADCAST else df


def attached(rows: DataFrame, facts: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """rows joined with facts (one row for each key, with n, the number of rows that have it).

    Keys with a ``parts``-th of all rows or more are ``parts`` at most by arithmetic: their facts are broadcast, so that no hot key's
    rows meet in one task. All other keys are small, and their rows are shuffled.
    """
    total, keys = facts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = F.col("n") * parts >= total
    often = F.broadcast(facts.where(hot).drop("n"))
    seldom = rows.join(often.select(key), key, "left_anti").join(held(facts.where(~hot).drop("n"), keys), key)
    return rows.join(often, key).unionByName(seldom)


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of runs of characters outside ASCII white space; null: 0. One pass: each word, with the space before it, becomes one sign."""
    inner = F.btrim(plain(text), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(inner, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")).cast("long")


def text_bytes(text: Column) -> Column:
    return F.octet_length(plain(text)).cast("long")


def unsigned_unit(hash64: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(hash64, 11).cast("double") + 0.5) / float(1 << 53)


def replacing(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns; input columns of the same names (in any case) give way."""
    names = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))
