"""Composite queries: gates and their report."""
