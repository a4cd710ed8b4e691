"""Document-value analytics on Spark: clean, segment, vote, audit, report."""
