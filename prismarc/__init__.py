"""A Spark-first analytics engine for content archives."""
