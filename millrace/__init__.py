"""Change-data capture, match-and-merge and operational queries on Spark."""
