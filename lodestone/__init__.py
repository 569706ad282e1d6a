"""Spark-native analytics over source-code corpora: files, symbols, edges, full-text search and ranked context."""
