"""Code-index analytics on Spark: build and query a four-layer index over many repositories."""
