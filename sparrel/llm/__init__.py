"""Training-data operators on Spark DataFrames.

Nothing else in the library imports this subpackage, so it can be removed as a
whole. ``sparrel.llm.queries`` registers one query for each operator.
"""
