"""Customer analytics on Spark DataFrames: one governed row per customer, and what follows from it."""
