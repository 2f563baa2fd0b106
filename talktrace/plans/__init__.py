"""The queries on the driver's tables."""
