"""Snapshots that a stream writes: each tick once, checked first, so that readers keep the last good one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tables


def ticks(df: DataFrame, root: str) -> DataFrame:
    """The ledger of finished ticks: (version)."""
    try:
        return df.sparkSession.read.schema("version long").parquet(f"{root}/finished")
    except Exception as x:  # noqa: BLE001  no tick yet; Spark has one class for every such error
        if "PATH_NOT_FOUND" not in str(x):
            raise
        return df.sparkSession.range(0).select(F.col("id").alias("version"))


def put(df: DataFrame, tick: int, root: str, check: Callable[[DataFrame], DataFrame]) -> str:
    """Write a tick: OK, or STALE if the ledger has it or a later one, or REFUSED if `check`, a table (rule, n), finds anything.

    Only a written and checked tick enters the ledger, so a batch that is run again adds nothing and a bad one hides nothing.
    """
    last = ticks(df, root).agg(F.max("version")).first()[0]
    if last is not None and last >= tick:
        return "STALE"
    try:
        tables.require(check(df))
    except ValueError:
        return "REFUSED"
    # A folder of an earlier attempt that failed before its end isn't in the ledger and gives way.
    df.write.mode("overwrite").parquet(f"{root}/versions/{tick}")
    df.sparkSession.createDataFrame([(tick,)], "version long").write.mode("append").parquet(f"{root}/finished")
    return "OK"


def stream(rows: DataFrame, make: Callable[[DataFrame], DataFrame], root: str, check: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch of a stream, through `make`, as a snapshot below `root`; the batch's number is its tick.

    A refused batch is skipped, and the stream goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = make(batch).persist()
        try:
            put(made, number, root, check)
        finally:
            made.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
