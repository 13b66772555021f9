"""Streaming re-aims of the report's ingest and activity series.

R1 ``ingest_files``: new files dropped in a folder are appended to a bronze
table; rows that fail to parse go to a quarantine table. Each micro-batch is
written with ``foreachBatch`` into its own ``batch_id`` partition (dynamic
overwrite), so together with the checkpoint a re-run batch is idempotent.

R2 ``run_windows`` / ``read_windows``: tumbling event-time windows per event
type. Every micro-batch is aggregated on its own and appends its windows' counts
to a table; counts are mergeable, and the reader adds them. So the stream holds
no state however many days it runs, a late row of any age counts (an aggregation
with a watermark would drop it), and a further run reads new files only. The
watermark is kept as data: the reader tells which windows it has passed.

Checkpoints and outputs live under the shared checkpoint folder
(``spark.checkpoint.dir``), never on a machine-local path of a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.operators.aggregate import attach_scalars
from budgetlens.session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def _ntz_epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def wall_clock_as_utc(c: str):
    """A TIMESTAMP_NTZ wall clock as the instant with that wall clock in UTC
    (watermarks need TIMESTAMP): microseconds since the NTZ epoch, read as
    microseconds since the Unix epoch. No time zone is involved, so the
    windows do not depend on the session time zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _ntz_epoch(), F.col(c)))


def utc_wall_clock_text(c):
    """Inverse of :func:`wall_clock_as_utc`, rendered as text."""
    ntz = F.timestamp_add("MICROSECOND", F.unix_micros(c), _ntz_epoch())
    return F.date_format(ntz, "yyyy-MM-dd HH:mm:ss")


#: Rows of the windows' table, one for each window and type of a micro-batch;
#: times in microseconds, values in exact hundredths, ``latest`` the last event.
PARTIALS = "start long, end long, event_type string, n long, cents decimal(38,0), latest long"


def window_partials(events: DataFrame, window: str = "1 day") -> DataFrame:
    """The counts of one micro-batch; ``ts`` must be a TIMESTAMP. Rows are counted
    in every task first, so a window with very many rows is one row a task when
    it is shuffled. Rows without a time are in no window."""
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("decimal(20,0)")
    per = events.filter("ts is not null").groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).cast("decimal(38,0)").alias("cents"),
        F.max(F.unix_micros("ts")).alias("latest"))
    return per.select(F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "event_type",
                      "n", "cents", "latest")


def run_windows(spark: SparkSession, source_dir: str, table: str, glob: str = "events.parquet",
                window: str = "1 day", files_per_batch: int | None = None) -> list[dict]:
    """Run R2 over the files of ``source_dir`` that ``table`` has not seen yet
    (``availableNow``) and append their windows' counts to it. ``files_per_batch``
    only cuts the work into smaller batches: counts add up the same however files
    fall into batches. Returns rows read and state rows (none) by batch, for the
    last batches that the session keeps.

    A batch's counts go into a partition of their own that a repeated batch
    overwrites; earlier partitions are never touched, so readers see a whole
    table at any time. The checkpoint belongs to the table."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(source_dir).select(wall_clock_as_utc("ts").alias("ts"), "event_type", "value")

    def append(batch: DataFrame, batch_id: int) -> None:
        (window_partials(batch, window).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table))

    q = (events.writeStream.foreachBatch(append).option("checkpointLocation", f"{table.rstrip('/')}-checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return [{"batch_id": p["batchId"], "input_rows": p["numInputRows"],
             "state_rows": sum(o["numRowsTotal"] for o in p["stateOperators"])} for p in q.recentProgress]


def read_windows(spark: SparkSession, table: str, delay_days: float = 1.0) -> DataFrame:
    """All windows of a table that ``run_windows`` feeds: its counts added up.
    ``closed``: the window's end is at least ``delay_days`` before the latest
    event of the table, so only late rows can still come."""
    rows = spark.read.schema(f"{PARTIALS}, batch_id long").parquet(table)
    per = rows.groupBy("start", "end", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    seen = attach_scalars(per, rows.agg(F.max("latest").alias("_latest")))
    return seen.select(
        utc_wall_clock_text(F.timestamp_micros("start")).alias("window_start"),
        utc_wall_clock_text(F.timestamp_micros("end")).alias("window_end"), "event_type", "n",
        (F.col("cents") / 100).cast("double").alias("value_sum"),
        (F.col("end") + F.lit(int(delay_days * 86_400_000_000)) <= F.col("_latest")).alias("closed"))


def activity_windows(spark: SparkSession, source_dir: str, glob: str = "events.parquet",
                     window: str = "1 day", files_per_batch: int | None = None,
                     table: str | None = None) -> DataFrame:
    """R2 over the files present now: ``run_windows`` into ``table`` (a new one
    below the shared checkpoint folder if none is given), then its windows."""
    table = table or scratch_path(spark, "activity-windows")
    run_windows(spark, source_dir, table, glob, window, files_per_batch)
    return read_windows(spark, table).drop("closed")


def ingest_files(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "csv",
                 bronze: str | None = None, quarantine: str | None = None,
                 options: dict[str, str] | None = None, checkpoint: str | None = None) -> tuple[str, str]:
    """Append every new file of ``source_dir`` to ``bronze``; records
    that fail to parse go to ``quarantine`` with their raw text. Runs the
    files available now and returns the two table paths.

    The checkpoint belongs to the bronze table (beside it, unless another is
    given): a later run into the same table takes only new files and goes on
    numbering its batches, so earlier partitions stay."""
    bronze = bronze or scratch_path(spark, "bronze")
    quarantine = quarantine or f"{bronze.rstrip('/')}-quarantine"
    ckpt = checkpoint or f"{bronze.rstrip('/')}-checkpoint"
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    reader = spark.readStream.schema(full).format(fmt).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    stream = reader.load(source_dir).withColumn("source_file", F.input_file_name())

    def write(batch: DataFrame, batch_id: int) -> None:
        # Each micro-batch owns the partition batch_id=N and overwrites it, so
        # a batch re-run after a failure replaces its rows instead of
        # appending them twice.
        batch = batch.withColumn("batch_id", F.lit(batch_id))
        bad = F.col("_corrupt_record").isNotNull()
        # Read the batch's files once for both tables.
        batch = batch.persist()
        for df, path in ((batch.filter(~bad).drop("_corrupt_record"), bronze),
                         (batch.filter(bad).select("source_file", "batch_id", "_corrupt_record"), quarantine)):
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("batch_id").parquet(path))
        batch.unpersist()

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return bronze, quarantine


def events_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 on the star schema's events: the bronze copy, per event type."""
    bronze, _ = ingest_files(spark, sf_dir, EVENTS_SCHEMA, fmt="parquet",
                             options={"pathGlobFilter": "events.parquet"})
    b = spark.read.parquet(bronze)
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
                                       .alias("value_sum"))
