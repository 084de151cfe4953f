"""What the operators share: the shared folder, staged tables and their scopes, and joins whose small side is checked."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: White space that separates words: space and U+0009 to U+000D.  (fixed value of the contracts)
SPACE = r"[\x20\x09-\x0D]"
#: A side of a join is broadcast only up to so many bytes, counted before: ROW_BYTES and 16 for each column of a row, and its texts.
BROADCAST_BYTES, ROW_BYTES, COLUMN_BYTES = 24 << 20, 32, 16

_APP = uuid.uuid4().hex[:12]
_SCOPE: ContextVar[str] = ContextVar("spanloom_scope", default="session")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder of the scope that is open."""
    return f"{shared_dir(spark)}/spanloom-{_APP}/{_SCOPE.get()}/{name}-{uuid.uuid4().hex[:12]}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that no scope owns."""
    return f"{shared_dir(spark)}/spanloom-kept/{name}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end, and nothing else: results of the scope must be written before it closes."""
    name = uuid.uuid4().hex[:12]
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, f"{shared_dir(spark)}/spanloom-{_APP}/{name}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_spanloom_path", path)
    return out


def drop(*staged: DataFrame) -> None:
    """Deletes tables made by stage() that their owner has done with: nothing lazy may read them any more."""
    for df in staged:
        delete(df.sparkSession, df._spanloom_path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a staged table for broadcast if its counted bytes are within the bound; else leaves it to a shuffle join."""
    fixed = ROW_BYTES + COLUMN_BYTES * len(df.columns)
    texts = [F.coalesce(F.octet_length(c.name), F.lit(0)) for c in df.schema.fields if isinstance(c.dataType, (StringType, BinaryType))]
    width = F.lit(fixed)
    for t in texts:
        width = width + t
    rows = most // fixed + 1
    held = df.limit(rows).agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if held[0] < rows and (held[1] or 0) <= most else df


def keep_ids(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a staged one-column table of ids, broadcast only within the bound.

    AQE splits a hot key of df in the shuffle join."""
    (c,) = ids.columns
    ids = small(ids.withColumnRenamed(c, "__sl_key"))
    return df.join(ids, df[key] == ids["__sl_key"], how)


def words_in(text: Column) -> Column:
    """The words of a text as an array; null or blank: empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def set_python_limits() -> None:
    """One thread for each Python worker: Spark runs as many workers as an executor has cores."""
    for k in ("TOKENIZERS_PARALLELISM", "RAYON_RS_NUM_THREADS"):
        os.environ[k] = "false" if k.startswith("TOK") else "1"
