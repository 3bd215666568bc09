"""deltaweave: program analysis and corpus processing as Spark DataFrame fixpoints."""
