"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution coalesces small partitions, splits skewed ones and picks
#: broadcast joins from measured sizes; the operators rely on it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False):
    """The parquet table ``name`` of a data folder.

    ``heavy`` is for queries that spend long on every row: a table of fewer
    scan partitions than the cluster has cores is spread over the cores first.
    Larger tables are read as they are, without a shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if heavy and df.rdd.getNumPartitions() < cores else df
