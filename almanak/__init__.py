"""almanak: search, counting, calendar and text processing over a personal archive, on Spark DataFrames."""
