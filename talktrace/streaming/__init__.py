"""The incremental pull as a stream of files."""
