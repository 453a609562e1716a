"""Analytics of debate transcripts on Spark."""
