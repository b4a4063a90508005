"""Independent SQL answers (DuckDB dialect) used to check the Spark results."""
