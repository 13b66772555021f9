"""Uploaded-file handling: catalogue, type dispatch, preview, landing.

The catalogue reads file metadata only (``binaryFile`` does not load the
content column unless it is selected). Previews are computed per format
over all files of that format at once; per-file limits are expressed with
positions inside each file, so no file is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.functions.text import preview_text

# Upload types the report accepts, by file extension.
ACCEPTED_TYPES = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "json": "application/json",
    "txt": "text/plain",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "parquet": "application/vnd.apache.parquet",
}
READABLE = ("csv", "json", "txt", "parquet")


def _name_ext(path_col: str = "path"):
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return name, ext


def file_catalog(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row per file: name, extension, content type, size in bytes and
    as ``12.34 KB`` text, modification time (S5)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder) \
        .select("path", "length", "modificationTime")
    name, ext = _name_ext()
    types = F.create_map(*[x for k, v in ACCEPTED_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return df.select(
        name.alias("name"), ext.alias("extension"),
        F.coalesce(F.element_at(types, ext), F.lit("application/octet-stream")).alias("content_type"),
        F.col("length").alias("size_bytes"),
        F.format_string("%.2f KB", F.col("length") / 1024.0).alias("size_text"),
        "modificationTime", "path")


def dispatch(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split the catalogue into files a reader exists for and rejected ones
    with a reason (S6)."""
    ok = F.col("extension").isin(*READABLE)
    known = F.col("extension").isin(*ACCEPTED_TYPES)
    rejected = catalog.filter(~ok).withColumn(
        "reason", F.when(known, F.lit("accepted type without a reader")).otherwise(F.lit("unsupported type")))
    return catalog.filter(ok), rejected


def preview_text_files(spark: SparkSession, folder: str, glob: str = "*.txt", n: int = 500) -> DataFrame:
    """First ``n`` characters of each text file, ``...`` when longer."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter=glob)
    name, _ = _name_ext("path")
    return df.select(F.input_file_name().alias("path"), "value") \
             .select(name.alias("name"), preview_text("value", n).alias("preview"))


def preview_json_files(spark: SparkSession, folder: str, glob: str = "*.json", n: int = 3) -> DataFrame:
    """A JSON object is shown whole; a JSON array shows its first ``n``
    items (S9). Invalid files get ``error`` set (S7)."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter=glob) \
              .select(F.input_file_name().alias("path"), "value")
    name, _ = _name_ext("path")
    v = F.try_parse_json(F.col("value"))
    kind = F.schema_of_variant(v)
    first = F.to_json(F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, n))
    return df.select(
        name.alias("name"),
        F.when(v.isNull(), F.lit(None)).when(kind.startswith("ARRAY"), first)
         .otherwise(F.to_json(v)).alias("preview"),
        F.when(v.isNull(), F.lit("invalid JSON")).alias("error"))


def preview_csv_files(spark: SparkSession, folder: str, glob: str = "*.csv", n: int = 5) -> DataFrame:
    """The header and first ``n`` data lines of each CSV file, as raw lines
    ``(name, line_no, line)`` (S9). A file's first split holds its first
    lines; line numbers come from positions inside that split."""
    df = spark.read.text(folder, pathGlobFilter=glob).select(
        F.input_file_name().alias("path"), "value",
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("pos"))
    first = df.groupBy("path").agg(F.min(F.struct("pid", "pos")).alias("f"))
    j = df.join(first, "path") \
          .filter((F.col("pid") == F.col("f.pid")) & (F.col("pos") - F.col("f.pos") <= n))
    name, _ = _name_ext("path")
    return j.select(name.alias("name"), (F.col("pos") - F.col("f.pos")).alias("line_no"),
                    F.col("value").alias("line"))


def land_files(spark: SparkSession, folder: str, bronze: str, glob: str = "*") -> None:
    """Copy uploaded files unchanged into the bronze table, one partition
    per file name; a file uploaded again replaces only its own partition
    (S8)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name, ext = _name_ext()
    out = df.select(name.alias("source_name"), ext.alias("extension"), "length", "modificationTime", "content")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_name").parquet(bronze))
