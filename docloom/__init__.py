"""A retrieval engine and corpus tools on Spark."""
