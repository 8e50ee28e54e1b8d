"""Join strategies, projections, partitioning, cardinality and sealing."""
