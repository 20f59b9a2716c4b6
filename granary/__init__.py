"""granary: a table store and query engine whose relations are Spark DataFrames."""
