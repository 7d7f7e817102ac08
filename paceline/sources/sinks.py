"""Where results go: JSON reports, and snapshots of which only the courses at hand are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls left out."""
    df.write.mode("overwrite").json(path)


def write_courses(parts: DataFrame, path: str, by: str = "course_id", buckets: int = 64) -> None:
    """Replace the partitions that ``parts`` has rows of and leave all others: courses are spread over ``buckets`` folders.

    ``parts`` has all rows of the buckets that it touches, as `switched` gives them.
    """
    folder = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
    out = parts.withColumn("bucket", folder).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def switched(stored: DataFrame, fresh: DataFrame, by: str = "course_id", buckets: int = 64) -> DataFrame:
    """Rows of all buckets that hold a course of ``fresh``, with that course's rows replaced by those of ``fresh``."""
    new = fresh.select(by).distinct()
    bucket = F.pmod(F.xxhash64(by), F.lit(buckets))
    near = stored.withColumn("_b", bucket).join(new.select(bucket.alias("_b")).distinct(), "_b", "left_semi").drop("_b")
    return near.join(new, by, "left_anti").unionByName(fresh)
