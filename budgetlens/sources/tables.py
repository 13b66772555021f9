"""Star-schema tables at rest (Parquet), read lazily by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from budgetlens.sources.schemas import STAR_TABLES


class Tables:
    """``Tables(spark, sf_dir).lineitem`` -> the lineitem DataFrame.

    Reads are lazy: column pruning and filter pushdown reach the Parquet
    scan because every query is expressed on top of these DataFrames.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in STAR_TABLES:
            raise KeyError(f"unknown table {name!r}")
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in STAR_TABLES:
            return self.table(name)
        raise AttributeError(name)
