"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows with whole texts that are sent to Python at once; Spark itself bounds their bytes.
TEXT_BATCH_ROWS = 1000
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Partitions among which the rows of one hot key are dealt.
SALTS = 64

_own_dir: str | None = None
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset a local master, whose tasks
    run on the driver's machine, gets a temporary folder, and a cluster is refused."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tesselite-")
    return _own_dir


def _on_path(spark: SparkSession, path: str) -> tuple:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = _on_path(spark, path)
    fs.deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Deletes what ``materialise`` wrote and nothing reads any more."""
    for df in kept:
        if path := _paths.pop(df, None):
            fs, jpath = _on_path(df.sparkSession, path)
            fs.delete(jpath, True)


def kept_and(rows: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    """The types of ``rows``' kept columns, whatever their names, and further ones."""
    return T.StructType([rows.schema[c] for c in keep] + T.StructType.fromDDL(more).fields)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, rows: int = TEXT_BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` whose function gets at most ``rows`` rows at once, so that what it makes of long texts stays small.  A session
    that leaves Spark's default gets such batches from the start, which saves executors memory; one with a setting of its own keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, str(TEXT_BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def merge_join(rows: DataFrame, other: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join by sorting alone, for operators of very many small joins: each broadcast would take the driver a job, a thread and
    memory that stays until it collects garbage."""
    return rows.join(other.hint("merge"), on, how)


def spread_join(rows: DataFrame, few: DataFrame, key: str | list[str], by: Column, left: bool = False, salts: int = SALTS, merge: bool = False) -> DataFrame:
    """``rows`` join ``few`` (inner, or left), which holds each value of ``key`` once; of ``rows`` one value may hold any share.
    Each value's row goes to as many salts as the value has among ``rows`` (at most ``salts``), counted where the
    rows are, so that no task meets all rows of a hot value.  by: what deals a value's rows.  merge: as ``merge_join``."""
    join = merge_join if merge else DataFrame.join
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    met = join(salted.select(*keys, "_salt").distinct(), few, keys, "inner")
    return join(salted, met, [*keys, "_salt"], "left" if left else "inner").drop("_salt")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
