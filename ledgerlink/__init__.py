"""Spark-first analytics over bitemporal registry graphs."""
