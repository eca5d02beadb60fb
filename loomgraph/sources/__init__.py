"""Sources and sinks: Parquet folders and the single-file binary format."""
