"""Natural-hazard analytics expressed as Spark DataFrame plans."""
