"""Request and response routing: a reply goes to the last client that wrote to its target."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_client(packets: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``client`` to responses: the last requester of the target before them, null if none.

    ``packets``: target, direction (request or response), src, and the order columns.
    """
    w = Window.partitionBy("target").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    client = F.last(F.when(F.col("direction") == "request", F.col("src")), ignorenulls=True).over(w)
    return packets.withColumn("client", client).where(F.col("direction") == "response")


def unknown(routed: DataFrame) -> DataFrame:
    """Responses of each target without a client: they are dropped."""
    return routed.where(F.col("client").isNull()).groupBy("target").agg(F.count("*").alias("dropped"))


def acknowledgement(payload: Column) -> Column:
    return F.when(F.startswith(payload, F.lit("SENSOR")), "ACK_SENSOR").when(F.startswith(payload, F.lit("HEARTBEAT")), "ACK_HEARTBEAT").when(F.startswith(payload, F.lit("ALERT")), "ACK_ALERT")


def check_endpoint(protocol: str, bind: str | None = None) -> tuple[str, str]:
    """(protocol, bind address); datagrams only, any case, all addresses by default."""
    if protocol.lower() != "udp":
        raise ValueError(f"protocol {protocol!r} is not supported")
    return "udp", bind or "0.0.0.0"
