"""Operators for building training data: extraction, quality rules,
duplicates, secrets, licenses, contamination, scoring, packing, toxicity.

Nothing else in the library imports this package. Functions that run inside
Spark tasks are shipped by value, so workers need no copy of the package on
their import path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
