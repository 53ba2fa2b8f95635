"""Ordered, versioned key-value tables on PySpark."""
