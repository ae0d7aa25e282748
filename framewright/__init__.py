"""Framewright: frame, identity and text analytics as PySpark DataFrame operators."""
