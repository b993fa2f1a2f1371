"""fieldspark: analytics over fields sampled on periodic lattices, as Spark jobs."""
