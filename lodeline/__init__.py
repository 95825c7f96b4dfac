"""Lodeline: markup evidence, contracts and lineage as Spark DataFrames."""
