"""A set of named Parquet tables with one row of metadata: save, load, read or build."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import ids


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/spanloom-tables"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table once and reads it back; all its tables are deleted at the end, so results must be local by then."""
    tables = TableSet(spark, f"{work_dir(spark)}/{uuid.uuid4().hex}")
    try:
        yield lambda df: tables.save(uuid.uuid4().hex, df)
    finally:
        tables.clear()


class TableSet:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """by: a column to partition by, which lookups prune to one folder."""
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}") if by is None else self.load(name)

    def load(self, name: str, defaults: dict[str, str] | None = None) -> DataFrame:
        """defaults: SQL for columns that older tables lack."""
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.selectExpr("*", *[f"{sql} AS {c}" for c, sql in (defaults or {}).items() if c not in df.columns])

    def read_or_build(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.load(name) if self._exists(name) else self.save(name, build())

    def set_metadata(self, **values: object) -> None:
        self.spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/metadata")

    def metadata(self) -> dict[str, object]:
        return {r.key: json.loads(r.value) for r in self.load("metadata").collect()} if self._exists("metadata") else {}

    def keeper(self) -> Callable[[DataFrame], DataFrame]:
        """Writes each table it is given under a name of its own below `steps` and gives it back; drop("steps") deletes them."""
        return lambda df: self.save(f"steps/{uuid.uuid4().hex}", df)

    def drop(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def names(self, out: str, docs: DataFrame, col: str = "doc_name") -> None:
        docs.select(col).write.mode("overwrite").json(out)


def upgrade_records(old: DataFrame) -> DataFrame:
    """Flat span records from (lookup_term, records): record_index dense, text and title filled from term and ''."""
    flat = old.select("lookup_term", F.posexplode("records").alias("pos", "r")).select("lookup_term", "pos", "r.*")
    filled = flat.withColumns({"text": F.coalesce("text", "term"), "title": F.coalesce("title", F.lit(""))})
    return ids.dense(filled, ["lookup_term", "pos"], "record_index")


def binary_texts(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """path, text of binary documents (such as PDF), by an extractor of the caller's, in Arrow batches; one document is one row.

    spans.split_documents() cleans and chunks them."""

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([None if x is None else extract(x) for x in col.to_pylist()], pa.string())

    return spark.read.format("binaryFile").load(path).select("path", convert("content").alias("text"))


def valid_gzip(spark: SparkSession, path: str) -> DataFrame:
    """path, valid: whether each file decompresses to its end, step by step.  Files are read where Spark reads them."""

    @F.arrow_udf("boolean")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(raw: bytes) -> bool:
            at = 0
            try:
                while at < len(raw):
                    z = zlib.decompressobj(31)
                    while not z.eof:
                        part = raw[at : at + (1 << 20)]
                        if not part:
                            return False
                        z.decompress(part, 1 << 20)
                        while z.unconsumed_tail:
                            z.decompress(z.unconsumed_tail, 1 << 20)
                        at += len(part) - len(z.unused_data)
            except zlib.error:
                return False
            return len(raw) > 0

        for col in batches:
            yield pa.array([one(x or b"") for x in col.to_pylist()])

    return spark.read.format("binaryFile").load(path).select("path", whole("content").alias("valid"))
