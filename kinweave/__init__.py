"""kinweave: record linkage and the relational analytics around it, on Spark DataFrames."""
