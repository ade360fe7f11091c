"""Knowledge-graph and table analytics on Spark DataFrames."""
