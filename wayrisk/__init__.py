"""Transport-network risk jobs on Spark."""
