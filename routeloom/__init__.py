"""routeloom: AND-OR route search and route analytics on Spark DataFrames."""
