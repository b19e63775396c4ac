"""Knowledge-graph query sampling and pattern counting on Spark DataFrames."""
