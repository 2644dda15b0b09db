"""Structured Streaming forms of the stateless query fragment and of the mergeable operators."""
