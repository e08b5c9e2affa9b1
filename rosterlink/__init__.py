"""Record cleaning, classification and linkage for Spark DataFrames."""
