"""leafmill: Spark-first analytics over a mirrored document collection."""
