"""Spark-native analytics for annotated directed graphs, pulse dynamics and run records."""
