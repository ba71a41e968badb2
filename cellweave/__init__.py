"""cellweave: cell-population analytics as Spark DataFrame jobs."""
