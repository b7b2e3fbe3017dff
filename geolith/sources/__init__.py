"""Readers and the logical tables that the operators work on."""
