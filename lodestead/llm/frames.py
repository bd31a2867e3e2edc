"""Small helpers that the operators share: reading, batch sizes, result rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that go to a Python worker at once. Texts can be long, so few of them.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a long and ``text`` as a string, and no other column."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket(column, n: int):
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Free memory of a Python worker returned to the machine. Workers outlive their tasks, and what a finished
    one had would count against the executor while later steps run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose function yields column dictionaries in the order of ``schema``."""
    spark = df.sparkSession
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        try:
            for columns in work(batches):
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
                del columns
        finally:
            give_back()

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if int(before) <= 0 or int(before) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, kind)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``;
    only a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestead-corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left: Spark removes shuffle files, broadcasts and checkpoints once
    the driver's collector finds them unused, which between many short steps it may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: like a checkpoint, but compressed
    and by columns, for what is large or read in parts. The folder may go when the job is done."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
