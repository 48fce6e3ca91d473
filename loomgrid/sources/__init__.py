"""Sources and sinks: Parquet scans, generators with known results, result files."""
