"""tessera: version-aware corpus analytics expressed as Spark DataFrame transformations."""
