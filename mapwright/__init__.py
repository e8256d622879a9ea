"""Build, query and measure two-dimensional maps of entities with PySpark."""
