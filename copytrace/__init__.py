"""Text-reuse and text-provenance analytics on Spark DataFrames."""
