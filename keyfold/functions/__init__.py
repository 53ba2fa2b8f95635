"""Part of the key-value engine."""
