"""Tables that are written once and read several times, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)
#: Folders that written() has used.
_used: set[str] = set()
#: (path, name) of tables that bucketed() has made.
_tables: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir.

    Where that is unset, local runs get a folder of their own; a cluster has none that all its machines see, so there it
    is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not context.getCheckpointDir():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="stayflow-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/stayflow-{context.applicationId}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet (with options of the writer) in the shared folder and read it back.

    Lost executors lose nothing of it, the plans that follow are short, and Spark knows its size, so that joins with it
    are broadcast only under spark.sql.autoBroadcastJoinThreshold; beyond it they are sort-merge joins whose hot
    partitions AQE splits.
    """
    spark = df.sparkSession
    _used.add(shared_dir(spark))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    if (made := _made.get()) is not None:
        made.append(found)
    return found


def buckets(spark: SparkSession) -> int:
    """Into how many buckets tables of stays are dealt: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, tag: str, key: str, order: str) -> DataFrame:
    """As written(), in one file for each bucket of `key`, sorted by key and `order`: windows and aggregations by key over
    what is read neither shuffle nor sort.

    df should be dealt by key in buckets() partitions already, as df.repartition(buckets(spark), key) and all windows after it
    are; otherwise a bucket has several files, which are right but sorted again when read. Spark trusts the order of a bucket's file only with
    spark.sql.legacy.bucketedTableScan.outputOrdering, which is set for the session. What was shuffled for the table is deleted
    when it is written. In the table the key has another name: renamed when read, it has lost the table's name, with which
    Spark 4.1 does not see that branches of a union are dealt alike.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    _used.add(shared_dir(spark))
    name = f"{tag}_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/{name}", buckets(spark)
    with _shuffles_deleted(spark):
        named = df.withColumnRenamed(key, f"{key}_of")
        named.write.format("parquet").option("compression", "zstd").bucketBy(n, f"{key}_of").sortBy(f"{key}_of", order).option("path", path).saveAsTable(name)
    found = spark.table(name).withColumnRenamed(f"{key}_of", key)
    found.written_at = path
    _tables.add((path, name))
    if (made := _made.get()) is not None:
        made.append(found)
    return found


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """What written() gives inside is deleted at the end, but for the tables that the function yielded is called with.

    A plan that is run after the end must read kept tables alone.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield lambda *tables: kept.extend(tables)
    except BaseException:
        kept.clear()
        raise
    finally:
        _made.reset(token)
        release(*[t for t in made if not any(t is k for k in kept)])
        if (outer := _made.get()) is not None:
            outer.extend(kept)


def release(*tables: DataFrame) -> None:
    """Delete tables that written() gave and that nothing reads any more."""
    for table in tables:
        if path := vars(table).get("written_at"):
            _forget(table.sparkSession, path)
            delete(table.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all that written() left in shared folders; results that read it must be stored by then."""
    while _used:
        folder = _used.pop()
        _forget(spark, folder)
        delete(spark, folder)


def _forget(spark: SparkSession, folder: str) -> None:
    """Tables that lie in a folder leave the session's list of tables."""
    for path, name in [x for x in _tables if x[0] == folder or x[0].startswith(f"{folder}/")]:
        _tables.discard((path, name))
        spark.sql(f"drop table if exists {name}")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the file system that the path names; one that is there is replaced."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, resolved as Spark does it: without one it lies in the default file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
