"""Evidence-graph analytics on Spark: snapshots, relations, reviews and records as DataFrames."""
