"""Relational analytics on Spark DataFrames with the semantics of a full SQL database."""
