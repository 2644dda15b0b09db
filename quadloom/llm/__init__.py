"""Operators that prepare text for training: packing, leak search and spam pages."""
