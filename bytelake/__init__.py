"""bytelake: compiled JVM code as Spark tables, and the queries over them."""
