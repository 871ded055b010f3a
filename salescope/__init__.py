"""salescope: sales analytics operators as Spark DataFrame jobs.

Every operator is a pure function ``(Tables or DataFrame, *, params) -> DataFrame``.
No operator triggers an action; the caller decides when and where to run.
"""

from salescope.sources.tables import Tables, load_tables, star_tables

__all__ = ["Tables", "load_tables", "star_tables"]
