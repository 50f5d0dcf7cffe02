"""Document retrieval analytics as composable PySpark DataFrame transformations."""
