"""martlight: marketplace analytics expressed as Spark jobs over whole tables."""
