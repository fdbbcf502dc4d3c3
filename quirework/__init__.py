"""Document reconstruction analytics on Spark."""
