"""Key-value analytics on Spark: keyed jobs, placement planning and job records as DataFrame queries."""
