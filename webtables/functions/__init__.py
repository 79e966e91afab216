"""Column-level building blocks made of built-in Spark functions."""
