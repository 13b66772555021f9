"""budgetlens: progress and budget reporting analytics on Spark.

Every public function takes and returns DataFrames (or Columns) and only
builds logical plans; nothing runs until the caller triggers an action.
Column names are parameters, so the same operators run on the small
departmental CSV files and on a star schema read from Parquet.
"""

from budgetlens.session import checkpoint_root, get_spark

__all__ = ["get_spark", "checkpoint_root"]
