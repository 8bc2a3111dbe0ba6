"""Readers, writers and test-table bindings."""
