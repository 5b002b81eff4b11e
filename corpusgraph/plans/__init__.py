"""Composite jobs built from several operators."""
