"""Sources and sinks: CSV, Parquet stores, logs, and relations derived from raw tables."""
