"""lexigrid: distributional semantics and corpus processing as Spark DataFrame plans."""
