"""Registered queries: each joins logical tables to operators; SQL of the same rows beside it."""
