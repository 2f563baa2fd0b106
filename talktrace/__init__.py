"""Discussion-archive analytics as Spark DataFrame transformations."""
