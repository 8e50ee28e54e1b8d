"""Equi-joins between narrow relations, and what is needed to generate, read, partition, seal, time and combine them, on Spark DataFrames."""
