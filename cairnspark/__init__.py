"""Log mining, rating recommendation and wide-table classification on Spark DataFrames."""
