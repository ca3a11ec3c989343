"""Audit analytics over large tables of public contracts, built on Spark DataFrames."""
