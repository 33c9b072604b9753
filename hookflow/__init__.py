"""Event ingestion, refinement and observability as Spark jobs.

Every operator is a function from DataFrames to a DataFrame; nothing here keeps
state outside Spark tables and streaming checkpoints.
"""
