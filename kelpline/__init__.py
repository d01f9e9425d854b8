"""A Spark engine for recall over conversation archives."""
