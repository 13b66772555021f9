"""The departmental source files mapped onto the report's entity columns.

``load_sources`` reads the files; the functions here rename their columns
to the names the report queries use (``plans.report_queries``). Nothing is
computed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.sources.files import Sources


def _rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()], "ord")


def items(src: Sources) -> DataFrame:
    return _rename(src.items, {
        "Section": "section", "Item": "item", "Target": "target",
        "Current Status": "current_status", "Percentage Achieved": "pct_achieved",
        "Budget Allocated": "allocated", "Budget Utilized": "utilized"})


def sectors(src: Sources) -> DataFrame:
    return _rename(src.sectors, {
        "Sector": "sector", "Budget_Allocation": "budget_allocation",
        "Budget_Utilization": "budget_utilization", "Projects_Count": "projects_count",
        "Beneficiaries": "beneficiaries", "Implementation_Percentage": "implementation_percentage"})


def months(src: Sources) -> DataFrame:
    return _rename(src.months, {
        "Month": "month", "Budget_Allocation": "budget_allocation",
        "Budget_Utilization": "budget_utilization", "Grievances_Received": "grievances_received",
        "Grievances_Resolved": "grievances_resolved", "ProjectsCompleted": "projects_completed",
        "NewProjectsStarted": "new_projects_started", "TrainingSessions": "training_sessions",
        "OnlineServiceHits": "online_service_hits"})


def districts(src: Sources) -> DataFrame:
    return _rename(src.districts, {
        "District": "district", "Budget_Allocation": "budget_allocation",
        "Budget_Utilization": "budget_utilization", "Projects_Count": "projects_count",
        "Implementation_Percentage": "implementation_percentage",
        "Population_Covered": "population_covered", "Grievances_Resolved": "grievances_resolved"})
