"""The registry of queries of this package, with the SQL that an oracle can run on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paceline.plans import aggregates, bindings, imports, landing, listings, mechanisms, rankings, texts

#: Modules that register queries when they are imported.
MODULES = (listings, aggregates, rankings, texts, imports, landing, mechanisms)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event catalogue: participations of each event, all and a club's."""
    return bindings.QUERIES["event_catalogue"](spark, sf_dir)


def queries() -> dict[str, bindings.Query]:
    return dict(bindings.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bindings.ORACLE)
