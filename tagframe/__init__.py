"""A PySpark engine for tables of tagged binary image containers."""
