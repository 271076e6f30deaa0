"""Composed plans and the registered query catalog."""
