"""Template queries over append-only property graphs, compiled to Spark DataFrame plans."""
