"""Aggregates and expressions that the engine adds to Spark's."""
