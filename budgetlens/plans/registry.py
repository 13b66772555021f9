"""All registered queries: name -> ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from budgetlens.plans import star, star_report, text_queries

QUERIES = {}
QUERIES.update(star.QUERIES)
QUERIES.update(text_queries.QUERIES)
QUERIES.update(star_report.QUERIES)

from budgetlens.plans import star_io  # noqa: E402

QUERIES.update(star_io.QUERIES)
