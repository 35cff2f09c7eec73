"""Table operations on Spark DataFrames: ingest, query, edit, evolve, copy, sync."""
