"""coachload: Spark-native passenger-crowding analytics.

Every operator takes and returns a Spark DataFrame (or a Column for the
per-row helpers in ``coachload.functions``).  Nothing is collected to the
driver except one-row scalars that Catalyst folds in as scalar subqueries.
"""

__version__ = "0.1.0"
