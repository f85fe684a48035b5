"""Case linkage and case analytics on Spark DataFrames."""
