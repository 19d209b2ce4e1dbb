"""Survey data quality as PySpark DataFrame operators."""
