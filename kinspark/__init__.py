"""Spark-native analytics for labelled point data (members, groups, graphs, embeddings, statistics)."""
