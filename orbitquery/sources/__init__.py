"""Readers, sinks and extractor hooks."""
