"""Declared schemas for the departmental source files.

The reference reads these files with type inference; we declare the types
and check them at load, which also makes the CSV traps explicit
(``NA`` tokens, a trailing blank after the last number, a stored ``Total``
row).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Options every departmental CSV is read with: ``NA`` is the missing-value
# token and cells may carry blanks around the number.
CSV_OPTIONS = {
    "header": "true",
    "nullValue": "NA",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
}

SECTION_ITEMS = T.StructType([
    T.StructField("Section", T.StringType()),
    T.StructField("Item", T.StringType()),
    T.StructField("Target", T.StringType()),
    T.StructField("Current Status", T.StringType()),
    T.StructField("Percentage Achieved", T.IntegerType()),
    T.StructField("Budget Allocated", T.DoubleType()),
    T.StructField("Budget Utilized", T.DoubleType()),
])

SECTORS = T.StructType([
    T.StructField("Sector", T.StringType()),
    T.StructField("Budget_Allocation", T.DoubleType()),
    T.StructField("Budget_Utilization", T.DoubleType()),
    T.StructField("Projects_Count", T.IntegerType()),
    T.StructField("Beneficiaries", T.LongType()),
    T.StructField("Implementation_Percentage", T.IntegerType()),
])

MONTHS = T.StructType([
    T.StructField("Month", T.StringType()),
    T.StructField("Budget_Allocation", T.DoubleType()),
    T.StructField("Budget_Utilization", T.DoubleType()),
    T.StructField("Grievances_Received", T.IntegerType()),
    T.StructField("Grievances_Resolved", T.IntegerType()),
    T.StructField("ProjectsCompleted", T.IntegerType()),
    T.StructField("NewProjectsStarted", T.IntegerType()),
    T.StructField("TrainingSessions", T.IntegerType()),
    T.StructField("OnlineServiceHits", T.IntegerType()),
])

DISTRICTS = T.StructType([
    T.StructField("District", T.StringType()),
    T.StructField("Budget_Allocation", T.DoubleType()),
    T.StructField("Budget_Utilization", T.DoubleType()),
    T.StructField("Projects_Count", T.IntegerType()),
    T.StructField("Implementation_Percentage", T.IntegerType()),
    T.StructField("Population_Covered", T.IntegerType()),
    T.StructField("Grievances_Resolved", T.IntegerType()),
])

# The six file names the report reads, keyed by role.
SOURCE_FILES = {
    "items": "SampleTabularData.csv",
    "text": "SampleTextUnstructuredData.txt",
    "json": "SampleJSONData.json",
    "months": "TimeSeriesData.csv",
    "sectors": "SectoralDistribution.csv",
    "districts": "DistrictData.csv",
}

CSV_SCHEMAS = {
    "items": SECTION_ITEMS,
    "months": MONTHS,
    "sectors": SECTORS,
    "districts": DISTRICTS,
}

# Tables of the star schema used for scale tests (one Parquet file each).
STAR_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
