"""Document-flow analytics and training-data preparation on Spark."""
