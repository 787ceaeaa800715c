"""jobloom: batch workload planning and corpus processing as Spark jobs."""
