"""Keyed work: hash partitions, strict order inside a partition, timeouts, drain and discard."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.hashing import fnv1a, murmur2, partition_of

HASHES = {"fnv1a": fnv1a, "murmur2": murmur2}


def assign(items: DataFrame, key: str, partitions: int, algorithm: str = "fnv1a") -> DataFrame:
    """Adds ``part``: the hashed key (text, or bytes as they are) modulo ``partitions``.

    A whole number is the partition itself and must be one.
    """
    kind = dict(items.dtypes)[key]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        fits = F.col(key).between(0, partitions - 1)
        return items.withColumn("part", F.when(fits, F.col(key).cast("int")).otherwise(F.raise_error(F.lit(f"partition must be 0 to {partitions - 1}")).cast("int")))
    return items.withColumn("part", partition_of(HASHES[algorithm](F.col(key) if kind == "binary" else F.col(key).cast("string")), partitions))


def sequence(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``seq``, the place of each item in its partition's queue."""
    return items.withColumn("seq", F.row_number().over(Window.partitionBy("part").orderBy(*order)))


def outcomes(items: DataFrame, timeout_ms: int | None, duration: str = "duration_ms", fails: str = "fails") -> DataFrame:
    """Adds ``outcome``: done, timeout or error.  An item past its time is cancelled; the queue goes on."""
    late = (F.col(duration) > timeout_ms) if timeout_ms else F.lit(False)
    return items.withColumn("outcome", F.when(late, "timeout").when(F.col(fails), "error").otherwise("done"))


def schedule(items: DataFrame, order: list[str], timeout_ms: int | None = None) -> DataFrame:
    """One worker a partition, first in first out: adds outcome, start_ms and end_ms.

    A timed-out item holds its worker for the timeout only.
    """
    out = outcomes(items, timeout_ms)
    held = F.least(F.col("duration_ms"), F.lit(timeout_ms)) if timeout_ms else F.col("duration_ms")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("end_ms", F.sum(held).over(w)).withColumn("start_ms", F.col("end_ms") - held)


def stop(items: DataFrame, at_ms: int, drain: bool) -> DataFrame:
    """Scheduled items at a stop: drain finishes all that is queued, discard only what had ended by then."""
    return items.withColumn("processed", F.lit(True) if drain else F.col("end_ms") <= at_ms)


def process(items: DataFrame, partitions: int, order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work`` over each partition's items in their order, partitions side by side.

    Every item of partition p is in task p; ``work`` sees ordered batches and may keep state between
    calls within the task.
    """
    dealt = items.repartitionById(partitions, "part").sortWithinPartitions("part", *order)
    return dealt.mapInPandas(lambda it: (work(b) for b in it), schema)


def process_each(items: DataFrame, partitions: int, order: list[str], work: Callable[[dict], object]) -> DataFrame:
    """The columns of ``items`` with ``result`` (string) and ``error``: each item on its own, in the order of its partition.

    An item that raises is a dead letter: it keeps its row, with the error's text and no result, and the
    queue goes on with the next one.
    """
    schema = StructType([*items.schema.fields, StructField("result", StringType()), StructField("error", StringType())])

    def run(batches):
        for b in batches:
            results, errors = [], []
            for item in b.to_pylist():
                try:
                    value = work(item)
                except Exception as exc:
                    results.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
                else:
                    results.append(None if value is None else str(value))
                    errors.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "result", "error"])

    return items.repartitionById(partitions, "part").sortWithinPartitions("part", *order).mapInArrow(run, schema)


def balance(items: DataFrame) -> DataFrame:
    """Items of even and odd partitions and their absolute difference."""
    n = items.agg(F.count(F.when(F.col("part") % 2 == 0, 1)).alias("even"), F.count(F.when(F.col("part") % 2 != 0, 1)).alias("odd"))
    return n.withColumn("difference", F.abs(F.col("even") - F.col("odd")))
