"""Typed readers, fact views and sinks."""
