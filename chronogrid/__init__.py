"""Spark-native analytics over dated observations: a cube language, series, spatial and survey operators."""
