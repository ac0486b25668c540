"""Security-telemetry analytics as ordinary PySpark DataFrame jobs."""
