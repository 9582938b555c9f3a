"""Readers and writers of instances, results, partitions and id lists."""
