"""Readers and writers of RDF files, and relational tables seen as statements."""
