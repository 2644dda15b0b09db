"""SPARQL parser, algebra and compiler to DataFrame plans."""
