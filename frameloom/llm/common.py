"""Shared helpers of the text operators: tables in the shared folder, batches of whole texts, hashing."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to one step of Python code; texts stay whole, only fewer of them are held at once.
ROWS_AT_ONCE = 512
#: And about so many characters, so that a run of very long texts is held in smaller groups.
CHARS_AT_ONCE = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where it is unset, a session in one process (master
    local) gets a folder of its own; on a cluster that is an error, as no other machine could read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="frameloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there, and a lost
    executor costs nothing that was written. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(conf).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, to be handed to Python in Arrow batches of a few MB (unless the session sets another size): both
    sides of the pipe hold whole batches, outside the JVM's heap."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b", "67108864")
    if df.sparkSession.conf.get(key, usual[0]) in usual:
        df.sparkSession.conf.set(key, "8MB")
    return df


def give_back() -> None:
    """Hands memory that Arrow and the C library keep for later back to the machine; Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the texts of each as Python strings (None stays None)."""
    for batch in batches:
        start, chars, rows = 0, 0, batch.num_rows
        index = batch.schema.get_field_index(column)
        texts = batch.column(index)
        sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist() if rows else []
        for i in range(rows):
            chars += sizes[i]
            if i + 1 == rows or i + 1 - start >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(index).to_pylist()
                start, chars = i + 1, 0
    give_back()


def id_remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id gives null."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's argument is a value, not an expression to repeat."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(rows: int, rows_each: int) -> int:
    return max(1, math.ceil(rows / rows_each))


def quiet_tokenizers() -> None:
    """One thread for each Python worker: the cluster's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


class Remembered(dict):
    """A dict that makes a missing key's value and forgets everything but ``fixed`` once it holds over ``size`` more."""

    def __init__(self, size: int, make, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.fixed, self.most, self.make = fixed or {}, size + len(fixed or {}), make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
            self.update(self.fixed)
        self[key] = value
        return value
