"""gpsight: general-practice prescribing and quality-indicator analytics on Spark.

Every public operator takes DataFrames and returns a DataFrame. Operators work for all
practices at once; a single practice is a filter on the same plan, which Catalyst pushes
towards the scans. Nothing is collected to the driver.

Subpackages
-----------
sources    readers for the practice tables (Parquet, JDBC, views over the test tables), catalog
functions  column expressions (R-compatible arithmetic, id checks, Student-t p-value)
operators  the analysis operators (rates, spend, drug shares, correlation, register, profile)
plans      the query registry used by ``__spark_entry__`` and the DuckDB oracle SQL
"""

from gpsight.session import build_session, checkpoint_dir
from gpsight.sources.tables import PracticeTables

__all__ = ["build_session", "checkpoint_dir", "PracticeTables"]
