"""Readers, parsers, table bindings and sinks."""
