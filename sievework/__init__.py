"""Document analytics on Spark: operators, functions, sources, plans and streams."""
