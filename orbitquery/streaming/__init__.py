"""Incremental discovery of chips, and stateful progress of queries."""
