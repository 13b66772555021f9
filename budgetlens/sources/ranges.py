"""Files read by byte ranges: heads for previews, chunks for landing.

The catalogue gives each file's length; tasks open a file at an offset and read
so many bytes. A preview therefore costs one block a file, however large the
file is, and a landed file is many rows of bounded size. Files are opened with
``pyarrow.fs`` in the tasks: local and mounted folders, HDFS, S3 and GCS paths.
Spark's file scan lists no empty files, so they have no preview and are not landed.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from budgetlens.sources.catalog import file_catalog

#: Bytes of a preview's head, and of a landed chunk. Parquet's writer looks at its
#: buffer every hundred rows only, so chunks of this size keep it near 100 MB.
HEAD, CHUNK = 64 << 10, 1 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _read_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges`` (path, start, n, ...) with ``content``: the bytes from ``start``,
    ``n`` at most. One range at a time is in a task's memory."""
    schema = StructType.fromDDL(ranges.schema.simpleString()[7:-1] + ", content binary")
    target = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                path, start, n = (one.column(c)[0].as_py() for c in ("path", "start", "n"))
                store, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))  # Spark's paths are not escaped
                with store.open_input_file(inner) as f:
                    content = f.read_at(n, start)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.binary())], schema=target)

    return ranges.mapInArrow(run, schema)


def file_heads(spark: SparkSession, folder: str, glob: str = "*", size: int = HEAD) -> DataFrame:
    """(name, extension, size_bytes, whole, content): the first ``size`` bytes of
    every file; ``whole`` if that is all of it."""
    files = file_catalog(spark, folder, glob).select(
        F.regexp_replace("path", "^file:/*", "file:///").alias("path"), "name", "extension", "size_bytes",
        F.lit(0).cast("long").alias("start"), F.lit(size).cast("long").alias("n"))
    return _read_ranges(files).select("name", "extension", "size_bytes",
                                      (F.col("size_bytes") <= size).alias("whole"), "content")


def _text(content: str = "content"):
    """A head as text; bytes of a character that the head's end cuts become a
    replacement character, which is taken off."""
    text = F.decode(F.col(content), "UTF-8")
    return F.when(F.col("whole"), text).otherwise(F.regexp_replace(text, "�+$", ""))


def preview_text_heads(spark: SparkSession, folder: str, glob: str = "*.txt", n: int = 500) -> DataFrame:
    """(name, preview): the first ``n`` characters of each text file, ``...`` when
    longer, from 4 * n + 4 bytes a file."""
    heads = file_heads(spark, folder, glob, 4 * n + 4).withColumn("t", _text())
    more = F.length("t") > n
    return heads.select("name", F.concat(F.substring("t", 1, n), F.when(more, "...").otherwise("")).alias("preview"))


def preview_csv_heads(spark: SparkSession, folder: str, glob: str = "*.csv", n: int = 5,
                      size: int = HEAD) -> DataFrame:
    """(name, line_no, line, cut): the header (line 0) and first ``n`` data lines of
    each CSV file as raw lines, from its first ``size`` bytes. ``cut``: the line
    goes on beyond them; lines that begin beyond them are not shown."""
    heads = file_heads(spark, folder, glob, size).withColumn("t", _text())
    lines = heads.select("name", "whole", F.split(F.col("t"), r"\r\n|\n|\r").alias("l"))
    cells = lines.select("name", "whole", F.size("l").alias("of"), F.posexplode(F.slice("l", 1, n + 1)).alias("line_no", "line"))
    last = F.col("line_no") == F.col("of") - 1
    return cells.filter(~(last & (F.col("line") == ""))) \
        .select("name", "line_no", "line", (last & ~F.col("whole")).alias("cut"))


def land_chunks(spark: SparkSession, folder: str, bronze: str, glob: str = "*", chunk: int = CHUNK) -> str:
    """Append the files unchanged to the table ``bronze`` as rows of at most
    ``chunk`` bytes and return the upload's id (S8).

    A file uploaded again is appended again; ``landed`` shows each name's last
    complete upload, so an upload that broke off hides nothing. A file that grows
    or shrinks meanwhile is not complete.
    """
    upload = uuid.uuid4().hex
    size = F.col("size_bytes")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(chunk).cast("long")))
    ranges = file_catalog(spark, folder, glob).select(
        F.regexp_replace("path", "^file:/*", "file:///").alias("path"), F.col("name").alias("source_name"),
        "extension", "size_bytes", "modificationTime", F.current_timestamp().alias("landed_at"),
        F.lit(upload).alias("upload_id"), starts.alias("start"))
    ranges = ranges.withColumn("n", F.greatest(F.least(F.lit(chunk).cast("long"), size - F.col("start")), F.lit(0)))
    # One large file is many ranges: deal them over the tasks.
    dealt = ranges.repartition(F.col("path"), F.col("start"))
    _read_ranges(dealt).withColumn("sha256", F.sha2("content", 256)).drop("path").write.mode("append").parquet(bronze)
    return upload


def landed(spark: SparkSession, bronze: str) -> DataFrame:
    """The chunks of each name's last complete upload: all its bytes are there,
    each chunk as long as announced."""
    rows = spark.read.parquet(bronze)
    complete = rows.groupBy("source_name", "upload_id").agg(
        F.sum("n").alias("bytes"), F.max("size_bytes").alias("size"), F.max("landed_at").alias("landed_at"),
        F.min(F.length("content") == F.col("n")).alias("as_long")).filter("bytes = size and as_long")
    last = complete.groupBy("source_name").agg(F.max(F.struct("landed_at", "upload_id")).alias("l")) \
        .select("source_name", F.col("l.upload_id").alias("upload_id"))
    return rows.join(last, ["source_name", "upload_id"], "left_semi")


def restore(spark: SparkSession, bronze: str, target: str) -> DataFrame:
    """Write the landed files byte for byte below ``target`` (a URI or a shared
    folder) and return (source_name, bytes, sha256 of the whole file).

    A file is written by one task that holds a batch of its chunks at a time; files
    are dealt over the tasks. A chunk whose digest does not hold ends the job.
    """
    root = target if "://" in target else f"file://{quote(target)}"
    rows = landed(spark, bronze).select("source_name", "start", "content", "sha256")
    rows = rows.repartition(F.col("source_name")).sortWithinPartitions("source_name", "start")

    def run(batches):
        import hashlib
        import pyarrow as pa
        from pyarrow import fs

        name = out = whole = None
        size, done = 0, []

        def close():
            if out is not None:
                out.close()
                done.append((name, size, whole.hexdigest()))

        for batch in batches:
            for row in range(batch.num_rows):
                key, start, content, digest = (batch.column(c)[row].as_py() for c in range(4))
                if hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"damaged chunk of {key} at {start}")
                if key != name:
                    close()
                    store, inner = fs.FileSystem.from_uri(f"{root}/{quote(key)}")
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    name, out, whole, size = key, store.open_output_stream(inner), hashlib.sha256(), 0
                out.write(content)
                whole.update(content)
                size += len(content)
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("source_name", "bytes", "sha256"), zip(*done), strict=True)))

    had = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(8 << 20))
    try:
        found = rows.mapInArrow(run, "source_name string, bytes long, sha256 string").collect()
    finally:
        spark.conf.set(ARROW_BYTES, had)
    return spark.createDataFrame(found, "source_name string, bytes long, sha256 string")
