"""Streaming forms of event metrics and the incremental state-space update."""
