"""Schemas, readers, table layouts and sinks."""
