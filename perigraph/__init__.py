"""Spark-native analytics for point sets, graph diffusion and scale estimation."""
