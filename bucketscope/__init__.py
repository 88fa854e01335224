"""Analytics of an object store's metadata and operations, as Spark DataFrame functions."""
