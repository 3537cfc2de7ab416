"""Tabloom: a Spark-native engine for building and judging model-ready tables."""
