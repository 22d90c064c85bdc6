"""Job-posting index analytics as Spark DataFrame transformations."""
