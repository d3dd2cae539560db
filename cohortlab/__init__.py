"""cohortlab: event-level cohort analytics as composable Spark DataFrame functions.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
only builds a lazy plan; nothing is collected unless the function's contract is
a scalar or a tiny report (documented where it happens).
"""

__version__ = "0.1.0"
