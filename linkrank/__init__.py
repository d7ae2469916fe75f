"""Link and rank messy tables with Spark DataFrames."""
