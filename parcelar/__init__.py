"""Spark-native regionalization: partition attributed contiguity graphs into connected regions."""
