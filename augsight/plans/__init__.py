"""Composite jobs and the query catalog."""
