"""Reading many files of which some cannot be read.

A file that is cut off or damaged ends a Spark job. Here the files are read and
written in one job; where that job fails on a file, the file is set aside with
the reason and the others are read in two halves, and so on. A half that
succeeds is kept and not read again. No row of a file that failed is kept, also
where its first part could be read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from budgetlens.session import materialize

REJECTED = "path string, reason string"
#: Error conditions of Spark that tell of a file and not of the cluster.
FILE_ERRORS = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "MALFORMED_RECORD_IN_PARSING", "FAILED_READ")


def read_isolated(spark: SparkSession, paths: list[str],
                  read: Callable[[list[str]], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(rows, rejected): the rows of all files that can be read whole, written
    below the shared checkpoint folder, and (path, reason) of the others.

    ``read`` turns a list of paths into a DataFrame with a declared schema, for
    example ``lambda p: spark.read.schema(s).parquet(*p)``. Errors that are not
    about a file (a lost cluster, a full disk) are raised. One damaged file costs
    one more read of the files; many of them, some log2(files) reads. Without a
    readable file the rows are None.
    """
    parts: list[DataFrame] = []
    rejected: list[tuple[str, str]] = []
    groups = [list(dict.fromkeys(paths))]
    while groups:
        group = groups.pop()
        if not group:
            continue
        try:
            parts.append(materialize(read(group), "isolated"))
        except (PySparkException, Py4JJavaError) as e:
            reason = _reason(e)
            if reason is None:
                raise
            bad = [p for p in group if _names(reason, p)] or (group if len(group) == 1 else [])
            rejected += [(p, reason) for p in bad]
            rest = [p for p in group if p not in bad]
            half = (len(rest) + 1) // 2
            groups += [rest[half:], rest[:half]]
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part)
    return rows, spark.createDataFrame(rejected, REJECTED)


def _reason(e: Exception) -> str | None:
    """The line of an error that tells of a file; None for any other error."""
    for line in str(e).splitlines():
        at = re.search(rf"\[({'|'.join(FILE_ERRORS)})[A-Z_.]*\].*", line)
        if at:
            return at.group(0)[:500]
    return None


def _names(reason: str, path: str) -> bool:
    """Whether the reason names this file (a whole path, not the start of another)."""
    plain = re.sub(r"^file:/*", "/", path)
    return re.search(re.escape(plain) + r"(?![\w.-]*\w)", reason) is not None
