"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every job of this package. AQE coalesces small
# shuffle partitions, splits skewed join partitions and turns sort-merge joins
# into broadcast joins when a side turns out small at run time.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "budgetlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Local mode: the driver JVM is the only executor.
            builder = builder.config("spark.driver.memory", "16g")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediate tables.

    On a cluster this is the folder named by ``spark.checkpoint.dir`` (a
    shared file system every executor can reach); without it a cluster job
    fails rather than write to a machine-local folder. Only a local session
    (tests) without the setting gets a fresh local folder, recorded in the
    session so later calls agree.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().conf().get("spark.checkpoint.dir", "") or None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="budgetlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint root."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: lineage is cut, the result survives executor loss, and the
    plan runs once (``checkpoint(eager=True)`` computes it twice)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Session setting: partitions over which whole-text queries deal their rows.
TEXT_PARTITIONS = "budgetlens.text.partitions"


def spread_for_cpu(df, partitions: int | None = None):
    """For CPU-heavy per-row work (whole-text operators): deal the rows round-robin
    over ``partitions``, or over the number in the session setting
    ``budgetlens.text.partitions``. Without either the scan's own partitions
    stay. The choice is the caller's, never the input's size: it pays where a
    few files with one row group each would leave cores idle."""
    n = partitions or int(df.sparkSession.conf.get(TEXT_PARTITIONS, "0"))
    return df.repartition(n) if n else df
