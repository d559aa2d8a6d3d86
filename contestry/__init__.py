"""Two-sided contest analytics on the Spark DataFrame API."""
