"""Readers for the departmental sources.

* CSV tables with declared schemas, ``NA`` as null and blanks trimmed (S1).
* A free-text document read whole and stripped like Python's ``str.strip``
  (S2).
* A multi-line JSON document (S3).
* Optional sources: when any optional table is missing the report runs on
  the basic data only (S4), expressed as a capability flag plus empty typed
  DataFrames instead of a broad ``except``.

Each CSV row gets an ``ord`` column holding its position in the file, since
several report operators depend on file order (first row on ties, "drop the
last row").
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.functions.text import py_strip
from budgetlens.sources.schemas import CSV_OPTIONS, CSV_SCHEMAS, SOURCE_FILES

ORD = "ord"


def with_file_order(df: DataFrame) -> DataFrame:
    """Attach ``ord``: increasing with the position of the row in its file.

    ``monotonically_increasing_id`` puts the partition index in the upper
    bits, and file splits of one file are numbered in offset order, so the
    ids follow file order for a single file without any shuffle.
    """
    return df.withColumn(ORD, F.monotonically_increasing_id())


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType,
                   keep_order: bool = True) -> DataFrame:
    """Read a headed CSV with a declared schema; the header must match it."""
    reader = spark.read.options(**CSV_OPTIONS).option("enforceSchema", "false")
    df = reader.schema(schema).csv(path)
    return with_file_order(df) if keep_order else df


def has_header(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Whether the file's header names the schema's columns, in order (reads
    the first line only)."""
    found = spark.read.options(**CSV_OPTIONS).csv(path).columns
    return [c.strip().lower() for c in found] == [c.lower() for c in schema.names]


def rejected_cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cells of a CSV table that are not of their declared type (S7):
    ``(path, ord, column, value)``. The typed table holds NULL there, so a
    report made from it is incomplete by these cells."""
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = read_csv_table(spark, path, raw_schema)
    checks = [F.when(F.col(f"`{f.name}`").isNotNull()
                     & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(),
                     F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value")))
              for f in schema if not isinstance(f.dataType, T.StringType)]
    bad = raw.select(F.lit(path).alias("path"), ORD, F.explode(F.array_compact(F.array(*checks))).alias("b"))
    return bad.select("path", ORD, "b.column", "b.value")


def read_text_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path``, ``text`` (whole file, stripped)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.input_file_name().alias("path"), py_strip(F.col("value")).alias("text"))


def read_json_document(spark: SparkSession, path: str,
                       schema: T.StructType | None = None) -> DataFrame:
    """A JSON document spread over many lines (one object per file)."""
    reader = spark.read.option("multiLine", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_json_variant(spark: SparkSession, path: str) -> DataFrame:
    """The same document as one VARIANT value per file (schema-free)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.parse_json(F.col("value")).alias("doc"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


@dataclass(frozen=True)
class Sources:
    """The immutable set of inputs every report query reads."""

    items: DataFrame
    text: DataFrame
    json: DataFrame
    months: DataFrame
    sectors: DataFrame
    districts: DataFrame
    has_additional_data: bool
    rejected_cells: DataFrame


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return with_file_order(spark.createDataFrame([], schema))


def load_sources(spark: SparkSession, folder: str) -> Sources:
    """Load the six sources of a departmental report from ``folder``.

    The three optional tables (months, sectors, districts) are taken
    together: if any is missing or has another header, all three are empty and
    the flag is off. Cells that are not of their declared type are listed in
    ``rejected_cells``.
    """
    def p(role: str) -> str:
        return os.path.join(folder, SOURCE_FILES[role])

    items = read_csv_table(spark, p("items"), CSV_SCHEMAS["items"])
    text = read_text_document(spark, p("text"))
    doc = read_json_document(spark, p("json"))
    optional = ("months", "sectors", "districts")
    has_all = all(_exists(spark, p(r)) and has_header(spark, p(r), CSV_SCHEMAS[r]) for r in optional)
    frames = {r: read_csv_table(spark, p(r), CSV_SCHEMAS[r]) if has_all else
              empty_like(spark, CSV_SCHEMAS[r]) for r in optional}
    rejected = rejected_cells(spark, p("items"), CSV_SCHEMAS["items"])
    for role in optional if has_all else ():
        rejected = rejected.unionByName(rejected_cells(spark, p(role), CSV_SCHEMAS[role]))
    return Sources(items=items, text=text, json=doc, has_additional_data=has_all,
                   rejected_cells=rejected, **frames)


def month_date(month: Column) -> Column:
    """``Apr-2023`` -> DATE 2023-04-01; anything else (``Total``) -> NULL."""
    return F.try_to_date(month, "MMM-yyyy")
