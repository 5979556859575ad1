"""Contract-portfolio monitoring as Spark DataFrame plans."""
