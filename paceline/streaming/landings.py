"""Import as a stream: landed documents arrive in files, an address that was read lately is skipped across micro-batches, failures are rows.

State is one time per address: when its last landing was accepted. It is dropped as soon as the watermark says that no landing can come any more that it
would keep out, so the state holds the addresses of the last ``ttl`` and not all there ever were.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paceline.runtime import ship
from paceline.sources.landed import json_documents

LANDING = "address string, read_at timestamp, body string"


def landings(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of JSON lines ``address, read_at, body`` from the files that land under ``path``."""
    return spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files_per_batch).json(path)


def accepted_times(times: pd.Series, last: pd.Timestamp | None, ttl: dt.timedelta) -> tuple[list[int], pd.Timestamp | None]:
    """Places of the times that are accepted, taken in their order, and the last of them: each is ``ttl`` or more after the one before."""
    out = []
    for at, time in times.sort_values(kind="stable").items():
        if last is None or time >= last + ttl:
            out.append(at)
            last = time
    return out, last


def fresh_only(stream: DataFrame, ttl: dt.timedelta, late: str = "1 hour", address: str = "address", read_at: str = "read_at") -> DataFrame:
    """Landings that are read: of an address none within ``ttl`` of the one accepted before, whatever batch that came in.

    Landings that come more than ``late`` after newer ones are left out, and so is one that is older than the last accepted of its address. A null address or
    time isn't read. Of equal times of an address one is accepted. A task holds the landings of one address in one batch.
    """
    ship(stream.sparkSession)
    columns = stream.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        kept, last = accepted_times(rows[read_at], last, ttl)
        if last is not None:
            state.update((last.value // 1000,))
            free = (last + ttl).value // 1_000_000
            if free > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(free)
            else:
                state.remove()
        yield rows.loc[kept, columns]

    known = stream.where(F.col(address).isNotNull() & F.col(read_at).isNotNull()).withWatermark(read_at, late)
    return known.groupBy(address).applyInPandasWithState(step, stream.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def parsed(stream: DataFrame, schema: str) -> DataFrame:
    """``address, read_at, doc, failed``: bodies read by ``schema``; one that can't be read is a failure beside the others."""
    return json_documents(stream, schema).select("address", "read_at", F.when(~F.col("failed"), F.col("doc")).alias("doc"), "failed")


def import_landed(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed until now to ``to``. Started again with the same ``checkpoint`` it goes on where it ended, and what was imported isn't imported again."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
