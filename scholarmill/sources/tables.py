"""Named tables of a data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``data_dir``."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
