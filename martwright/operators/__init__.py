"""Operators over any DataFrame: ordering, quality checks, profiling, chart data, text and vectors."""
