"""Layered text memory on Spark: sources, operators, functions, plans and streaming jobs."""
