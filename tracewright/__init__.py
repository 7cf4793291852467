"""Document-graph analytics expressed as Spark plans."""
