"""Independent SQL statements of the expected results, for DuckDB on the sample tables."""
