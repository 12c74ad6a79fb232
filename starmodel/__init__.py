"""PySpark-native toolkit for star-schema warehouses."""
