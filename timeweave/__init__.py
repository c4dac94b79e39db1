"""timeweave: time-aligned, multi-source event analytics as Spark DataFrame building blocks."""
