"""Relational and kernel operators on graphs, partitions, populations and results."""
