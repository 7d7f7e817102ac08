"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a rate: rows wanted over rows there are. Every row draws from a Poisson
distribution with that mean by inverting it at a uniform number, which a hash of seed and id gives, so
the same row always gets the same number of copies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sources whose rates go to every executor; with more, the rates are joined as a table.
BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def uniform(key: F.Column) -> F.Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of ``key``."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, power: float, total: float | None) -> DataFrame:
    """``(source, rate)``: the mean number of copies of a row of each source.

    With ``weights`` (relative; a source that isn't named gets none) each source is to have its
    share of ``total`` rows, by default as many as there are. Without, the weight of a source is its
    number of rows to the power ``power``.
    """
    n = docs.groupBy(docs[source_col].cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    n = n.withColumn("weight", weight)
    sums = n.agg(F.sum("weight").alias("weights"), F.sum("n").alias("all")).first()
    wanted = float(total) if total is not None else float(sums["all"] or 0)
    share = F.col("weight") / F.lit(sums["weights"]) if sums["weights"] else F.lit(0.0)
    return n.select("source", (share * F.lit(wanted) / F.col("n")).alias("rate"))


def distributions(of: DataFrame) -> DataFrame:
    """``(source, steps)``: the Poisson distribution function at 0, 1, ... until it is 1 to the last bit but few."""
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("long")
    k = of.select("source", "rate", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.when((F.col("k") > 0) & (F.col("rate") > 0), F.log("rate") - F.log("k")).when(F.col("k") > 0, F.lit(-1e9)).otherwise(-F.col("rate"))
    k = k.withColumn("p", F.exp(F.sum(factor).over(upto))).withColumn("step", F.sum("p").over(upto))
    return k.groupBy("source").agg(F.sort_array(F.collect_list("step")).alias("steps"))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, total: float | None = None,
    seed: str = SEED, id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, plus ``copy`` (0, 1, ...) and ``shuffle_key``; shuffled over all partitions.

    A null source is a source of its own. Rows with equal ids draw alike; a null id draws as the
    empty string. A source with weight 0 has no rows. An empty table gives an empty result. Columns
    named ``copy`` or ``shuffle_key`` in the input are replaced; any other column is carried along.
    """
    of = distributions(rates(docs, source_col, weights, power, total)).withColumnsRenamed({"source": "_mix_source", "steps": "_mix_steps"})
    if of.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    id_text = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    drawn = docs.drop("copy", "shuffle_key").withColumn("_mix_u", uniform(F.concat(F.lit(f"{seed}|"), id_text)))
    drawn = drawn.join(of, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    n = F.size(F.filter("_mix_steps", lambda step: F.col("_mix_u") >= step))
    copies = drawn.withColumn("_mix_n", n).drop("_mix_steps", "_mix_source", "_mix_u").where("_mix_n > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1))).drop("_mix_n")
    key = F.md5(F.concat_ws("|", F.lit(seed), id_text, F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of ``documents`` for each copy; sources weigh as the square root of their size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS weight FROM n),
r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (SELECT sum(n) FROM w)::DOUBLE / n AS rate FROM w),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
f AS (SELECT source, k, exp(sum(CASE WHEN k > 0 THEN ln(rate) - ln(k) ELSE -rate END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS step FROM f),
s AS (SELECT source, list(step ORDER BY k) AS steps FROM c GROUP BY source),
d AS (SELECT *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
t AS (SELECT d.*, len(list_filter(s.steps, lambda x: d.u >= x)) AS times FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT * EXCLUDE (u, times), unnest(range(0, times))::INTEGER AS copy FROM t)
SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS shuffle_key FROM e
"""
