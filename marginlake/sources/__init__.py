"""Readers, validation, keyed merge and sinks."""
