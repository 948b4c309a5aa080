"""Typed readers for the input tables."""
