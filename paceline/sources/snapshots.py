"""Snapshots of several tables that change all together or not at all.

A version is a folder of its own, which nothing reads before it is whole and checked; then one small file, the pointer, is replaced. A job that
fails, or a check that refuses, leaves the version before as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paceline.operators.rows import is_unknown_time

POINTER = "CURRENT"


class Refused(Exception):
    """A version that its check didn't let through."""


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Replace the pointer: a new file is written beside it and renamed over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    new, at = fs.Path(f"{path}/.{POINTER}-{version}"), fs.Path(f"{path}/{POINTER}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(f"{version}\n".encode())
    out.close()
    where = fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    where.rename(new, at, overwrite)


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the version that the pointer names now; later versions don't change what this DataFrame reads."""
    return spark.read.parquet(f"{path}/versions/{current_version(spark, path)}/{table}")


def publish(tables: Mapping[str, DataFrame], path: str, refuse: Callable[[dict[str, DataFrame]], str | None] = lambda _: None) -> str:
    """Write ``tables`` as a new version and let the pointer name it. ``refuse`` sees them as written; if it gives a reason, `Refused` is raised and nothing changes.

    Tables may be derived from the version before. Versions that aren't current stay until they are removed.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    written = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{path}/versions/{version}/{name}")
    reason = refuse(written)
    if reason:
        raise Refused(reason)
    point_to(spark, path, version)
    return version


def observed(rows: DataFrame, time: str = "total_time") -> tuple[DataFrame, Observation]:
    """``rows`` and what one write of them counts along the way: ``n_rows``, ``n_without_time``, ``n_unknown_times`` (texts that are no time)."""
    seen = Observation()
    unknown = is_unknown_time(time)
    none = F.coalesce(F.trim(time), F.lit("")) == ""
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(none).alias("n_without_time"), F.count_if(unknown).alias("n_unknown_times")), seen


def cut_short(seen: Observation, announced: int | None) -> Callable[[dict[str, DataFrame]], str | None]:
    """A check for `publish`: refuses a ranking with fewer or more rows than the source announced."""
    return lambda _: f"{seen.get['n_rows']} rows of {announced}" if announced is not None and seen.get["n_rows"] != announced else None
