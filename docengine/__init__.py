"""A PySpark engine for document collections."""
