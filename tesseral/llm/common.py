"""Shared plumbing of the corpus operators: Arrow text access, checkpoints, shards."""
from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Characters between words wherever a contract says ``[^\x20\x09-\x0D]+``.
WORD_BREAKS = "\t\n\x0b\x0c\r "
#: Text bytes one shard should hold; shards are the unit a Python task keeps in memory.
SHARD_BYTES = 8 << 20
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blobs(column: pa.Array) -> list[bytes]:
    """The rows of a string or binary array as bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def ints(column: pa.Array, fill: int = NO_ID) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(fill).to_numpy(zero_copy_only=False)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the session's spark.checkpoint.dir.

    Where that setting is absent and all executors are threads of this process (tests, local runs) a folder
    of this machine is used; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "file://" + os.path.join(tempfile.gettempdir(), "tesseral-shared")


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut in the lineage.

    ``row_group``: bytes of a row group, for tables whose rows are large.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**({"parquet.block.size": row_group} if row_group else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, which stays in the JVM."""
    return docs.agg(F.sum(F.octet_length(docs[text].cast("string"))).alias("n")).first()["n"] or 0


def parallelism(size: int, spark: SparkSession, target: int = SHARD_BYTES) -> int:
    """Number of shards or buckets for ``size`` bytes, never under the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target))


def _hashed(v: np.ndarray) -> np.ndarray:
    """Spark's hash of int values (Murmur3, 32 bits, seed 42), as signed numbers."""
    m = np.uint64(0xFFFFFFFF)
    turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m
    k = turn((v.astype(np.uint64) & m) * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
    h = (turn(np.uint64(42) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(4)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & m
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & m
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32)


def even_labels(n: int) -> np.ndarray:
    """n numbers of which Spark's hash partitioning puts one into each of n partitions.

    Numbers 0 to n - 1 would leave some partitions empty and give others five and more.
    """
    found, at = np.full(n, -1, np.int64), 0
    while (found < 0).any():
        tried = np.arange(at, at + 4 * n, dtype=np.int64)
        p = _hashed(tried).astype(np.int64) % n
        first, place = np.unique(p, return_index=True)
        open_ = found[first] < 0
        found[first[open_]] = tried[place[open_]]
        at += 4 * n
    return found.astype(np.int32)


#: Shards up to which their labels (4 bytes each) are part of the plan.
LABELLED_SHARDS = 100_000


def shard_of(mixed: Column, n: int) -> Column:
    """The shard of a hashed key: an even label, or the plain number where there are very many."""
    k = F.pmod(mixed, F.lit(n)).cast("int")
    if n > LABELLED_SHARDS:
        return k
    return F.element_at(F.from_json(F.lit(str(even_labels(n).tolist())), "array<int>"), k + 1)


def whole_partition(f):
    """A function of all rows of a partition as one table, for partitions that are one bucket."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            out = f(pa.Table.from_batches(got))
            del got
            yield from out.to_batches(max_chunksize=4096)

    return tidy(run)


def with_fields(schema: StructType, more: str) -> StructType:
    """``schema`` with the fields of a DDL string behind its own; names of any kind, all may be null."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema] + list(DataType.fromDDL(more)))


def of(df: DataFrame, name: str) -> Column:
    """The top-level column of that name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def doc_columns(docs: DataFrame, key: str, text: str = "text") -> list[Column]:
    """The id as long under the name ``doc_id`` and the text as string, whatever else is there."""
    return [docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")]


def pieces(batch: pa.RecordBatch, limit: int = 16 << 20):
    """Slices of a batch with about ``limit`` bytes at most each, whole rows only."""
    if batch.num_rows and batch.nbytes > limit:
        step = max(1, int(batch.num_rows * limit / batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    elif batch.num_rows:
        yield batch


def trim() -> None:
    """Give freed memory back to the system: Python workers live on, and so would their peaks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """A batch function that trims when its task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def tidy_group(f):
    """A function of one group's table that trims after each group."""

    def run(table):
        out = f(table)
        trim()
        return out

    return run


def tidy_pair(f):
    """A function of two cogrouped tables that trims after each pair."""

    def run(left, right):
        out = f(left, right)
        trim()
        return out

    return run


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of all batches in one."""
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
