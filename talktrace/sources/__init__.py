"""Reading, flattening, checking and storing the archive."""
