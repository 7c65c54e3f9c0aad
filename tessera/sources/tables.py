"""Parquet tables of one data folder, read through Spark alone so that any store works."""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
