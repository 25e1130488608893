"""pointweave: Spark-first analytics over point clouds, codebooks and embeddings."""
